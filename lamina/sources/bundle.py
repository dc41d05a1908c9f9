"""An annotated matrix as a folder of Parquet tables: obs, var, x (long, with a column per layer), obsm_<name> and a JSON of the rest.

x is kept apart by block if obs has one, so reading one block reads only its files. Opening a bundle reads schemas only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that may name independent samples, and columns that may hold gene symbols, in order of preference.
BLOCK_KEYS = ("replicate", "sample_id", "sample", "donor", "library_id", "library", "batch")
SYMBOL_KEYS = ("gene_symbol", "gene_symbols", "feature_name", "gene_name", "symbol")


@dataclass
class Bundle:
    obs: DataFrame
    var: DataFrame
    x: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)

    def expression(self, layer: str | None = None) -> DataFrame:
        """obs_id, gene_id, value of the layer asked for, else of lognorm, else of value (or count, where that is all)."""
        if layer and layer not in self.x.columns:
            raise KeyError(f"no layer {layer} among {self.x.columns}")
        name = layer or next(c for c in ("lognorm", "value", "count") if c in self.x.columns)
        return self.x.select("obs_id", "gene_id", F.col(name).cast("double").alias("value"))

    def counts(self) -> DataFrame:
        """obs_id, gene_id, count of the counts if there are any, else of value."""
        name = next(c for c in ("count", "raw", "value") if c in self.x.columns)
        return self.x.select("obs_id", "gene_id", F.col(name).cast("double").alias("count"))

    def symbols(self) -> DataFrame:
        """gene_id, symbol from the first column that has symbols, else the gene_id as text."""
        name = next((c for c in SYMBOL_KEYS if c in self.var.columns), "gene_id")
        return self.var.select("gene_id", F.col(name).cast("string").alias("symbol"))

    def points(self, prefer_3d: bool = True) -> DataFrame:
        """obs with x, y, z: from obsm spatial_3d or spatial (arrays), or columns of obs; two dimensions lie at z = 0."""
        for k in ("spatial_3d", "spatial") if prefer_3d else ("spatial", "spatial_3d"):
            if k in self.obsm:
                xyz = self.obsm[k].select("obs_id", *(F.coalesce(F.get(F.col("value"), F.lit(i)).cast("double"), F.lit(0.0)).alias(c) for i, c in enumerate("xyz")))
                return self.obs.drop("x", "y", "z").join(xyz, "obs_id")
        if {"x", "y"} <= set(self.obs.columns):
            return self.obs if "z" in self.obs.columns else self.obs.withColumn("z", F.lit(0.0))
        raise KeyError("no coordinates: obsm spatial_3d or spatial, or columns x and y of obs")

    def blocks(self, key: str | None = None) -> DataFrame:
        """obs with a column block: the key asked for, else the first known one with more than one value, else one block. No edge joins two blocks."""
        if key is None:
            known = [k for k in BLOCK_KEYS if k in self.obs.columns]
            n = self.obs.agg(*(F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("Unknown"))).alias(k) for k in known)).first() if known else {}
            key = next((k for k in known if n[k] > 1), None)
        label = F.coalesce(F.col(key).cast("string"), F.lit("Unknown")) if key else F.lit("sample_0")
        return self.obs.withColumn("block", label)

    def write(self, path: str) -> None:
        """Writes all tables; x by block where obs has that column."""
        self.obs.write.mode("overwrite").parquet(f"{path}/obs")
        self.var.write.mode("overwrite").parquet(f"{path}/var")
        x = self.x
        if "block" in self.obs.columns and "block" not in x.columns:
            x = x.join(self.obs.select("obs_id", "block"), "obs_id")
        w = x.write.mode("overwrite")
        (w.partitionBy("block") if "block" in x.columns else w).parquet(f"{path}/x")
        for k, v in self.obsm.items():
            v.write.mode("overwrite").parquet(f"{path}/obsm_{k}")
        rest = json.dumps({"obsm": sorted(self.obsm), "uns": {k: v for k, v in self.uns.items() if not k.endswith("_colors")}})
        self.obs.sparkSession.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/uns")


def read(spark: SparkSession, path: str) -> Bundle:
    """Opens a bundle."""
    rest = json.loads(spark.read.text(f"{path}/uns", wholetext=True).first()[0])
    return Bundle(*(spark.read.parquet(f"{path}/{t}") for t in ("obs", "var", "x")), {k: spark.read.parquet(f"{path}/obsm_{k}") for k in rest["obsm"]}, rest["uns"])


def read_npz(spark: SparkSession, path: str, key: str = "timeseries", labels: str = "labels") -> tuple[DataFrame, DataFrame | None]:
    """(subject, t, region, value) and (subject, label) of a numpy archive with one series (times x regions) for each subject; such archives fit the driver's memory."""
    with np.load(path, allow_pickle=True) as z:
        series, lab = list(z[key]), (z[labels].tolist() if labels in z.files else None)
    rows = [(s, t, r, float(v)) for s, a in enumerate(series) for t, row in enumerate(np.asarray(a, float)) for r, v in enumerate(row)]
    out = spark.createDataFrame(rows, "subject bigint, t bigint, region bigint, value double")
    return out, None if lab is None else spark.createDataFrame([(i, str(x)) for i, x in enumerate(lab)], "subject bigint, label string")
