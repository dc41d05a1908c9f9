"""EDF, BDF and BrainVision files against the values they were written from, and band power of long signals."""

import numpy as np
import pytest

from lamina import skills
from lamina.operators import events
from lamina.sources import edf

R = np.random.default_rng(2)


def write_edf(path, signals, records, seconds=1.0, bdf=False, marks=None, count=None, reserved=""):
    """signals: (label, samples a record, digital values); marks: annotation text of each record."""
    chans = [(label, n, v) for label, n, v in signals]
    width = 3 if bdf else 2
    top = 2 ** (8 * width - 1)
    fields = [[c[0] for c in chans], [""] * len(chans), ["uV"] * len(chans), ["-100"] * len(chans), ["100"] * len(chans), [str(-top)] * len(chans), [str(top - 1)] * len(chans), [""] * len(chans), [str(c[1]) for c in chans], [""] * len(chans)]
    if marks is not None:
        room = 40
        for f, x in zip(fields, [("BDF" if bdf else "EDF") + " Annotations", "", "", "-1", "1", str(-top), str(top - 1), "", str(room), ""], strict=True):
            f.append(x)
    n = len(fields[0])
    head = (b"\xffBIOSEMI" if bdf else b"0".ljust(8)) + b" " * 176 + str(256 * (n + 1)).ljust(8).encode() + reserved.ljust(44).encode()
    head += str(records if count is None else count).ljust(8).encode() + str(seconds).ljust(8).encode() + str(n).ljust(4).encode()
    for (_, w), f in zip(edf.FIELDS, fields, strict=True):
        head += b"".join(x.ljust(w).encode() for x in f)
    body = b""
    for r in range(records):
        for _, k, v in chans:
            part = v[r * k : (r + 1) * k].astype("<i4")
            body += b"".join(int(x).to_bytes(3, "little", signed=True) for x in part) if bdf else part.astype("<i2").tobytes()
        if marks is not None:
            body += marks[r].ljust(room * width, b"\0")
    path.write_bytes(head + body)


@pytest.mark.parametrize("bdf", [False, True])
def test_samples_and_annotations(spark, tmp_path, bdf):
    path = tmp_path / ("a.bdf" if bdf else "a.edf")
    top = 2 ** (23 if bdf else 15)
    a, b, c = (R.integers(-top, top, 10 * n) for n in (8, 4, 8))
    a[:2] = -top, top - 1
    marks = [b"+%d\x14\x14\0" % (2 * r) + (b"+%d.5\x150.25\x14blink\x14eye\x14\0" % (2 * r) if r % 3 == 0 else b"") for r in range(10)]
    write_edf(path, [("Fp1", 8, a), ("Fp2", 4, b), ("Fp1", 8, c)], 10, 2.0, bdf, marks, count=-1)
    with open(path, "ab") as f:
        f.write(b"part of a record")
    scale = 200 / (2 * top - 1)
    want = {(n, i): (2.0 / k * i, -100 + (v + top) * scale) for n, k, x in (("Fp1#1", 8, a), ("Fp2", 4, b), ("Fp1#2", 8, c)) for i, v in enumerate(x.tolist())}
    d = edf.read(spark, str(path), partition=3 * 2 * (8 + 4 + 8 + 40) * (3 if bdf else 2) // 2)
    assert d.rdd.getNumPartitions() == 4
    got = {(r["channel"], r["i"]): (r["t"], r["value"]) for r in d.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["channel"] for r in edf.read(spark, str(path), channels="Fp2, Fp1#2").select("channel").distinct().collect()} == {"Fp2", "Fp1#2"}
    found = edf.read(spark, str(path), "events", partition=500).orderBy("onset", "text").collect()
    assert [tuple(r) for r in found] == [(2 * r + 0.5, 0.25, t) for r in (0, 3, 6, 9) for t in ("blink", "eye")]
    with pytest.raises(KeyError, match="there are Fp1#1, Fp2, Fp1#2"):
        edf.RecordingReader({"path": str(path), "channels": "Cz"})
    assert edf.rate(str(path)) == 4.0 and edf.rate(str(path), "Fp2") == 2.0


def test_records_with_times_of_their_own(spark, tmp_path):
    path = tmp_path / "d.edf"
    write_edf(path, [("X", 2, np.arange(6))], 3, 1.0, False, [b"+%d\x14\x14\0" % t for t in (0, 5, 60)], reserved="EDF+D")
    assert [(r["i"], r["t"]) for r in edf.read(spark, str(path)).orderBy("i").collect()] == [(0, 0.0), (1, 0.5), (2, 5.0), (3, 5.5), (4, 60.0), (5, 60.5)]
    write_edf(tmp_path / "none.edf", [("X", 2, np.arange(0))], 0)
    assert edf.read(spark, str(tmp_path / "none.edf")).count() == 0 and edf.read(spark, str(tmp_path / "none.edf"), "events").count() == 0
    with pytest.raises(ValueError, match="neither"):
        edf.layout(__file__)


@pytest.mark.parametrize("kind", ["INT_16", "IEEE_FLOAT_32"])
def test_interleaved_samples(spark, tmp_path, kind):
    v = R.integers(-99, 99, (500, 3)).astype(edf.FORMATS[kind])
    (tmp_path / "a.eeg").write_bytes(v.tobytes())
    (tmp_path / "a.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0,2024\nMk2=Stimulus,S  1,251,2,0\n")
    head = f"[Common Infos]\nDataFile=a.eeg\nMarkerFile=a.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels=3\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\nCh1=Fz,,0.5,uV\nCh2=C\\1z,,,\nCh3=Pz,,2\n"
    (tmp_path / "a.vhdr").write_text(head)
    d = edf.read(spark, str(tmp_path / "a.vhdr"), partition=1000)
    assert d.rdd.getNumPartitions() > 3
    assert {(r["channel"], r["i"]): (r["t"], r["value"]) for r in d.collect()} == {(n, i): (pytest.approx(i * 0.004), v[i, k] * s) for k, (n, s) in enumerate((("Fz", 0.5), ("C,z", 1.0), ("Pz", 2.0))) for i in range(500)}
    assert [tuple(r) for r in edf.read(spark, str(tmp_path / "a.vhdr"), "events").orderBy("onset").collect()] == [(0.0, 0.004, "New Segment"), (1.0, 0.008, "Stimulus/S  1")]


@pytest.mark.parametrize("seconds", [2.0, 0.35])
def test_power_of_long_signals_is_that_of_whole_ones(spark, seconds):
    fs, n = 100.0, 3010
    x = {c: np.sin(2 * np.pi * f * np.arange(n) / fs) + 0.3 * R.normal(size=n) for c, f in (("a", 10.0), ("b", 20.0))}
    s = spark.createDataFrame([(c, i, float(v)) for c, vs in x.items() for i, v in enumerate(vs)] + [("short", 0, 1.0), ("a", None, 1.0), ("a", 9999, None)], "channel string, i bigint, value double")
    got = {(r["channel"], r["band"]): (r["power"], r["relative"]) for r in events.segment_power(s, fs, seconds, segments=5).collect()}
    want = {(r["channel"], r["band"]): (r["power"], r["relative"]) for r in events.band_power(s.where("channel <> 'short' and i is not null and value is not null"), fs, seconds).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_a_skill_reads_a_recording(spark, tmp_path):
    i = np.arange(20 * 100)
    write_edf(tmp_path / "a.edf", [("Oz", 100, (8000 * np.sin(2 * np.pi * 10 * i / 100)).astype(int))], 20)
    done = skills.run(spark, "ephys.eeg_bandpower", {"signal": str(tmp_path / "a.edf")}, out=tmp_path / "runs")
    rows = spark.read.parquet(f"{done['path']}/result.parquet").collect()
    assert max(rows, key=lambda r: r["relative"])["band"] == "alpha"
