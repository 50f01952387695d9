"""The layer directory: one parquet dataset per asset layer."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from gridlake.functions.columns import ENERGY
from gridlake.functions.geo import with_shape
from gridlake.functions.wkb import KINDS

# The layers exported when none is named.
DEFAULT_LAYERS = (
    "CTMT", "CTAT", "SUB", "UNTRAT", "SSDMT", "SSDBT", "SSDAT", "UNTRMT", "UNSEMT", "UNSEBT",
    "UNREMT", "UNCRMT", "UCMT", "UCBT", "UCMT_tab", "UCBT_tab", "UGMT", "UGBT", "UGMT_tab",
    "UGBT_tab", "PIP", "PONNOT", "RAMLIG", "SEGCON", "CRVCRG", "EQTRMT", "EQSE", "BASE", "ARAT",
    "CONJ",
)
_DOUBLES = {"COMP", "POT_NOM", "POT_INST", "CAR_INST", "TEN_OPE", "PER_FER", "PER_TOT", "TAP",
            "TEN_LIN_SE", "R1", "X1", "CNOM", "CMAX", "R", "XHL", *ENERGY}
_INTEGERS = {"DIST", "TLCD", "BANC", "ATIP", "RECONFIG", "MRT", "LIV", "SEMRED"}


class MissingLayer(ValueError):
    """A required layer is not in the directory."""


def contract_type(column: str):
    """Type a column has in the published layer contract."""
    if column == "geometry":
        return BinaryType()
    if column in _DOUBLES or column.startswith("POT_"):
        return DoubleType()
    if column in _INTEGERS:
        return IntegerType()
    return StringType()


@dataclass
class LayerCatalog:
    """Names, columns and scans of the layers under one folder (local, HDFS or object store)."""

    spark: SparkSession
    path: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    _listing: dict[str, str] | None = None

    @classmethod
    def of(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> LayerCatalog:
        """A catalog over frames that are already defined (same rules as over files)."""
        return cls(spark, "", dict(frames))

    def layers(self) -> dict[str, str]:
        """Layer name -> dataset path, from one directory listing."""
        if not self.path:
            return {name: "" for name in self.frames}
        if self._listing is None:
            jvm = self.spark.sparkContext._jvm
            root = jvm.org.apache.hadoop.fs.Path(self.path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            found = {}
            for status in root.getFileSystem(conf).listStatus(root):
                name = status.getPath().getName()
                if name.endswith(".parquet"):
                    found[name[: -len(".parquet")]] = status.getPath().toString()
            self._listing = found
        return self._listing

    def has(self, layer: str) -> bool:
        return layer in self.frames or layer in self.layers()

    def _scan(self, layer: str) -> DataFrame:
        if layer in self.frames:
            return self.frames[layer]
        if layer not in self.layers():
            raise MissingLayer(f"layer {layer} is not in {self.path}")
        self.frames[layer] = self.spark.read.parquet(self.layers()[layer])
        return self.frames[layer]

    def columns(self, layer: str) -> list[str]:
        return self._scan(layer).columns

    def read(self, layer: str, columns: Iterable[str] | None = None) -> DataFrame:
        """Scan a layer; requested columns that do not exist are ignored, geometry is kept."""
        df = self._scan(layer)
        if columns is None:
            return df
        present = [c for c in dict.fromkeys(columns) if c in df.columns]
        if "geometry" in df.columns and "geometry" not in present:
            present.append("geometry")
        return df.select(*present)

    def table(self, layer: str, columns: Sequence[str]) -> DataFrame:
        """Exactly ``columns``: missing ones (or a missing layer) become typed nulls or no rows."""
        if not self.has(layer):
            return self.empty(columns)
        df = self._scan(layer)
        return df.select(
            *[
                F.col(c) if c in df.columns else F.lit(None).cast(contract_type(c)).alias(c)
                for c in columns
            ]
        )

    def empty(self, columns: Sequence[str]) -> DataFrame:
        schema = StructType([StructField(c, contract_type(c)) for c in columns])
        return self.spark.createDataFrame([], schema)

    def read_in(
        self, layer: str, column: str, values: Sequence | DataFrame, columns: Iterable[str] | None = None
    ) -> DataFrame:
        """Rows whose ``column`` is in ``values``.

        A Python list is the user's own short filter and is pushed to the scan; keys that come from
        data are a DataFrame and become a semi join. No value at all keeps the schema, no rows.
        """
        df = self.read(layer, columns if columns is None else [*columns, column])
        if isinstance(values, DataFrame):
            keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
            return df.join(keys, column, "left_semi")
        values = list(dict.fromkeys(values))
        return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))

    def resolve(self, requested: Iterable[str] | None = None) -> tuple[list[str], list[str]]:
        """(found, missing) layer names, ignoring case and repeats.

        Without a request the default set is used and missing layers are only reported; an explicit
        request with a missing layer is an error.
        """
        index = {name.upper(): name for name in {**self.layers(), **self.frames}}
        wanted = DEFAULT_LAYERS if requested is None else [r.strip() for r in requested if r.strip()]
        unique = {name.upper(): name for name in reversed(list(wanted))}
        ordered = [unique[k] for k in dict.fromkeys(n.upper() for n in wanted)]
        found = [index[n.upper()] for n in ordered if n.upper() in index]
        missing = [n for n in ordered if n.upper() not in index]
        if requested is not None and missing:
            raise MissingLayer(f"unknown layer(s): {', '.join(missing)}")
        return found, missing

    def base_metadata(self) -> DataFrame:
        """Utility, period, extraction date and description of the base: one row."""
        columns = ["DIST", "DAT_INC", "DAT_FNL", "DAT_EXT", "DESCR"]
        # of several rows the latest extraction counts, then the latest period and the smallest rest
        order = [F.col(c).cast("string").desc_nulls_last() for c in ("DAT_EXT", "DAT_FNL", "DAT_INC")] + [F.col(c).cast("string").asc_nulls_last() for c in ("DIST", "DESCR")]
        return self.table("BASE", columns).orderBy(*order).limit(1).select(
            F.col("DIST").cast("int").alias("DIST"),
            *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns[1:]],
        )


def conform_layer(df: DataFrame, geometry: str | None = None) -> DataFrame:
    """Rename the geometry column to ``geometry``; all other columns keep name and type."""
    return df if geometry in (None, "geometry") else df.withColumnRenamed(geometry, "geometry")


def export_layers(
    catalog: LayerCatalog,
    destination: str,
    layers: Iterable[str] | None = None,
    geometry: dict[str, str] | None = None,
) -> DataFrame:
    """Write each layer as its own dataset and return the manifest: rows and extent per layer.

    Rows, extents and kinds are observed while a layer is written, so nothing is scanned a second time.
    """
    found, _ = catalog.resolve(layers)
    if not found:
        raise MissingLayer("no layer to export")
    rows = []
    for layer in found:
        df = conform_layer(catalog.read(layer), (geometry or {}).get(layer))
        seen = Observation()
        if "geometry" in df.columns:
            shaped = with_shape(df, out="_shape")
            watched = shaped.observe(
                seen, F.count(F.lit(1)).alias("rows"), *[F.min(f"_shape.{c}").alias(c) for c in ("minx", "miny")], *[F.max(f"_shape.{c}").alias(c) for c in ("maxx", "maxy")],
                *[F.coalesce(F.max(F.col("_shape.kind") == k), F.lit(False)).alias(k) for k in KINDS.values()],
            ).drop("_shape")
        else:
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        watched.write.mode("overwrite").parquet(f"{destination}/{layer}.parquet")
        got = seen.get
        kinds = ";".join(sorted(k for k in KINDS.values() if got.get(k)))
        rows.append((layer, got["rows"], *[got.get(c) for c in ("minx", "miny", "maxx", "maxy")], kinds))
    # one row per layer
    return catalog.spark.createDataFrame(rows, "layer string, rows bigint, minx double, miny double, maxx double, maxy double, kinds string")


def layer_summary(df: DataFrame, layer: str) -> DataFrame:
    """One row: layer, row count, extent, geometry kinds."""
    if "geometry" in df.columns:
        shaped = with_shape(df.select("geometry")).select("shape.*")
        agg = shaped.agg(
            F.count(F.lit(1)).alias("rows"), F.min("minx").alias("minx"), F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
            F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"),
        )
    else:
        agg = df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", *[F.lit(None).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")],
            F.lit("").alias("kinds"),
        )
    return agg.select(F.lit(layer).alias("layer"), "rows", "minx", "miny", "maxx", "maxy", "kinds")
