"""URL filter: allow and block rules, and for all other pages a logistic regression on hashed character n-grams.

The regression reads host and path only. It is trained on the driver from labelled(), a table of 108 names
labelled by hand, under prefixes, endings and paths that are the same for both classes, by full-batch gradient descent in numpy;
its weights are one array of 2**16 numbers, so what goes to executors has a fixed size.

Cases: a null url, or one without "://", has an empty host and an empty path, matches no rule and is judged by the method
(with no n-gram but its boundary marks). Repeated rows get equal verdicts, an empty table gives an empty result, and
columns other than page_id and url are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (rule, verdict), a rule being a host and the start of a path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Names of sites labelled by hand, the kinds that a crawl filter lets in or keeps out.
ALLOWED = (
    "city-library", "daily-herald", "garden-notes", "openmaths", "university-press", "recipes-at-home", "history-museum", "weather-station",
    "thenorthern", "southerner", "another-view", "gathering", "lantern", "thrush", "heather", "weaver",
    "science-review", "railway-times", "poetry-archive", "river-trust", "astronomy-club", "school-lessons", "football-report", "parliament-minutes",
    "theatre", "tension", "nation", "station", "cookery", "walking-paths", "health-advice", "law-journal",
    "bird-watch", "museum-of-trade", "orchestra", "community-forum", "onion", "fashion", "shepherd", "ocean",
    "atlas", "thin-air", "session", "ration", "wind-and-sail", "fishing-weekly", "chess-problems", "old-photographs",
    "translation", "mountain-hut", "quiet-reader", "beekeeping", "stamp-collector", "village-council", "window-makers", "software-notes",
    "farmers-market", "county-records", "tracking-bears", "betterment-society", "adulthood-studies", "pillow-makers", "linkoping-guide", "winter-tales",
    "green-energy", "baker-street", "kitchen-table", "photo-essays", "language-school", "opera-house", "bridge-builders", "tide-tables",
)
BLOCKED = (
    "cheap-pills", "viagra-pills", "free-bets", "best-free-bets", "online-casino-bonus", "poker-bets", "adult-x", "adult-cams", "xxx-adult",
    "spam-farm", "spam-links", "link-farm", "buy-followers-cheap", "replica-watches-cheap", "casino-x", "free-porn-x", "pills-online", "win-bets",
    "adult-dating", "casino-free", "roulette-casino", "payday-loans-cheap", "crack-keygen-free", "warez-farm", "click-farm", "cheap-meds-pills", "bets-casino",
    "seo-spam-links", "banner-ads", "popup-ads", "click-ads", "jackpot-slots", "slots-casino", "hot-adult-cams", "miracle-pills", "phish-login-free",
)

#: What a name stands under. Every name has every prefix with two forms of path, and endings go round, so that none of them tells the classes apart.
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), (".com", ".org", ".net", ".example.com", ".example.org", ".example.net")
PATHS = ("/en/4512", "/de/88.html", "/fr/912/", "/es/7001", "/", "/news/today", "/shop/offer", "/archive/2019/index.html")


def labelled(allowed=ALLOWED, blocked=BLOCKED) -> list[tuple[str, str, float]]:
    """Host, path and label (1: block) of every name under all prefixes."""
    out = []
    for names, y in ((allowed, 0.0), (blocked, 1.0)):
        for i, name in enumerate(names):
            for j, prefix in enumerate(PREFIXES):
                for k in (0, len(PATHS) // 2):
                    out.append((f"{prefix}{name}{ENDINGS[i % len(ENDINGS)]}", PATHS[(i + j + k) % len(PATHS)], y))
    return out


#: Size of the hashed feature space, lengths of the n-grams, and how training goes.
_DIGIT, _md5 = re.compile("[0-9]"), partial(md5, usedforsecurity=False)
BUCKETS, LENGTHS, ROUNDS, RATE, DECAY = 1 << 16, (3, 4, 5), 1500, 2.0, 1e-4


def host_column(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_column(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null: a case for each rule, longest first."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, _, rest = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """The distinct buckets of the character n-grams of host and of path; digits are one symbol, as page numbers tell nothing. A bucket is the first 16 bits of an n-gram's MD5."""
    grams = set()
    for mark, part in (("h", host), ("p", path)):
        s = f"^{_DIGIT.sub('0', part)}$"
        grams.update(f"{mark}{s[i : i + n]}" for n in LENGTHS for i in range(max(1, len(s) - n + 1)))
    return np.unique(np.array([int.from_bytes(_md5(g.encode("utf-8", "surrogatepass")).digest()[:2], "big") for g in grams], np.int64))


def train(allowed=ALLOWED, blocked=BLOCKED) -> np.ndarray:
    """Weights for the probability that a URL is to be blocked; the last one is the bias."""
    table = labelled(allowed, blocked)
    rows = [features(h, p) for h, p, _ in table]
    y = np.array([label for *_, label in table])
    used, cols = np.unique(np.concatenate(rows), return_inverse=True)
    x = np.zeros((len(rows), len(used)))
    x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), cols] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    # the weights are a sum of rows, each with a share of its own: steps go over the shares and the rows' inner products
    near, share, b = x @ x.T, np.zeros(len(rows)), 0.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(near @ share + b))) - y
        share -= RATE * (error / len(y) + DECAY * share)
        b -= RATE * error.mean()
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = x.T @ share, b
    return out


def probability(weights: np.ndarray, host: str, path: str) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(len(f)) + weights[-1]))))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's probability of block (null where a rule decided)."""
    weights = train()
    verdict_of = dict(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, host, path, rule = (batch.column(k) for k in range(4))
            chance = [None if r is not None else probability(weights, h, p) for h, p, r in zip(host.to_pylist(), path.to_pylist(), rule.to_pylist(), strict=True)]
            verdict = [verdict_of[r] if r is not None else "block" if c >= threshold else "allow" for r, c in zip(rule.to_pylist(), chance, strict=True)]
            yield pa.RecordBatch.from_arrays([page, host, path, rule, pa.array(verdict, pa.string()), pa.array(chance, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "block_probability"])

    cut = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    cut = cut.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    return cut.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, block_probability double")


def oracle_sql(rules=RULES, threshold: float = 0.5) -> str:
    """The query's rows in DuckDB SQL: host, path and rule by expressions, the regression as a join of n-grams with the trained weights."""
    weights = train()
    rows = ", ".join(f"({i}, {float(weights[i])!r}::DOUBLE)" for i in np.flatnonzero(weights[:-1]).tolist())
    rule = "CASE"
    for r, _ in sorted(rules, key=lambda x: (len(x[0]), x[0]), reverse=True):
        h, _, rest = r.partition("/")
        rule += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}') THEN '{r}'"
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    gram = "SELECT page_id, rn, '{m}' || substr(s, i, n) AS g FROM (SELECT page_id, rn, s, n, unnest(range(1, 1 + greatest(1, len(s) - n + 1))) AS i FROM (SELECT page_id, rn, '^' || regexp_replace({c}, '[0-9]', '0', 'g') || '$' AS s, unnest([3, 4, 5]) AS n FROM u))"
    return f"""
WITH p AS (SELECT row_number() OVER () AS rn, page_id, url, strpos(url, '://') AS sep FROM pages),
r AS (SELECT rn, page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) END AS rest FROM p),
u AS (SELECT rn, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
w AS (SELECT * FROM (VALUES {rows}) v(b, w)),
g AS (SELECT DISTINCT rn, ('0x' || substr(md5(g), 1, 4))::INTEGER AS b FROM ({gram.format(m="h", c="host")} UNION ALL {gram.format(m="p", c="path")})),
x AS (SELECT rn, 1 / (1 + exp(-(coalesce(sum(w), 0) / sqrt(count(*)) + {float(weights[-1])!r}))) AS chance FROM g LEFT JOIN w USING (b) GROUP BY rn),
v AS (SELECT u.*, {rule} ELSE NULL END AS rule FROM u)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN chance >= {threshold} THEN 'block' ELSE 'allow' END END AS verdict FROM v JOIN x USING (rn)"""
