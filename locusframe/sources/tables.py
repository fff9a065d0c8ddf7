"""Tables: driver adaptors, localization files, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "timestamp_ntz'2024-01-01 00:00:00'"
#: Fixed header names of localization tables and what they are called here.
ALIASES = {
    "x [nm]": "x_nm", "y [nm]": "y_nm", "z [nm]": "z_nm", "frame": "frame", "intensity [photon]": "photons", "offset [photon]": "bg", "bkgstd [photon]": "bkgstd",
    "uncertainty_xy [nm]": "lpx_nm", "uncertainty [nm]": "lpx_nm", "uncertainty_z [nm]": "lpz_nm", "sigma1 [nm]": "sx", "sigma2 [nm]": "sy",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may go without one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder that all executors share and read again, which cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later table is computed from."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of a plane: id, x, y."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_retailprice as x", "p_size * 10.0D as y")


def sparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a few points of a plane: id, x, y."""
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_acctbal / 100 as x", "s_nationkey * 4.0D as y")


def slab_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of groups: grp, source_index, x, y, z."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_returnflag as grp", "l_orderkey * 10 + l_linenumber as source_index", "l_quantity as x", "l_discount * 1000 as y", "l_tax * 1000 as z")


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as localizations over time: grp, frame (minutes), x, event_id."""
    return read(spark, sf_dir, "events").selectExpr("user_id as grp", f"cast(floor(timestampdiff(SECOND, {START}, ts) / 60) as bigint) as frame", "value as x", "event_id")


def clustered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as localizations of clusters: id, label (-1 is noise), grp, x, y, z, frame, photons, lp."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "cast(l_partkey % 41 - 1 as int) as label", "l_returnflag as grp", "l_quantity as x", "l_discount * 1000 as y", "l_tax * 1000 as z",
        "l_orderkey as frame", "l_extendedprice as photons", "l_tax * 100 as lp", "cast(l_linenumber - 1 as bigint) as step",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as measurements nested in animals and groups: axon, animal, grp, value."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("axon"), F.col("c_custkey").alias("animal"), F.col("c_mktsegment").alias("grp"), F.col("o_totalprice").alias("value"))


def read_localizations(spark: SparkSession, path: str, pixel_size_nm: float | None = None, positional: bool = False) -> DataFrame:
    """A localization table (CSV, Parquet) in nm on every axis, frames from 0; columns without a known name are kept.

    CSV headers are found without regard to case, and of several that mean the
    same the first counts; with ``positional`` the first three columns are x, y,
    z in nm. A CSV without x, y and z is refused. Parquet columns x, y, lpx and
    lpy are camera pixels and need a pixel size, which is never guessed; z and
    lpz are in nm. A CSV whose frames start at 1 is shifted, unless its bkgstd
    is 0 throughout.
    """
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        names = {c: ("x_nm", "y_nm", "z_nm")[i] for i, c in enumerate(raw.columns[:3])} if positional else {}
        for c in raw.columns:
            name = ALIASES.get(c.strip().lower(), c if c not in names else None)
            if c not in names and name not in names.values():
                names[c] = name
        known = {*ALIASES.values(), "x_nm", "y_nm", "z_nm"}
        df = raw.select(*((F.col(f"`{c}`").cast("double") if n in known else F.col(f"`{c}`")).alias(n) for c, n in names.items()))
        if not {"x_nm", "y_nm", "z_nm"} <= set(df.columns):
            raise ValueError("no x, y and z columns in nm")
        if "frame" in df.columns:
            noise = F.max("bkgstd") if "bkgstd" in df.columns else F.lit(1.0)
            first, most = df.agg(F.min("frame"), noise).first()
            shift = 1 if first is not None and first >= 1 and most != 0 else 0
            df = df.withColumn("frame", F.col("frame").cast("bigint") - shift)
        return df
    df = spark.read.parquet(path)
    if not {"x_nm", "y_nm"} <= set(df.columns):
        if pixel_size_nm is None:
            raise ValueError("coordinates are in pixels and no pixel size is given")
        for c in ("x", "y", "lpx", "lpy"):
            if c in df.columns:
                df = df.withColumn(f"{c}_nm", F.col(c) * pixel_size_nm).drop(c)
        for c in ("z", "lpz"):
            if c in df.columns:
                df = df.withColumnRenamed(c, f"{c}_nm")
    return df if "z_nm" in df.columns else df.withColumn("z_nm", F.lit(0.0))


def lateral_precision(df: DataFrame) -> DataFrame:
    """``df`` with ``lp_nm``, the mean of the precisions in x and y, or the one there is; failed fits (null, NaN or not above 0) are null."""
    have = [F.col(c) for c in ("lpx_nm", "lpy_nm") if c in df.columns]
    if not have:
        return df.withColumn("lp_nm", F.lit(None).cast("double"))
    ok = F.lit(True)
    for c in have:
        ok = ok & ~F.isnan(c) & (c > 0)
    return df.withColumn("lp_nm", F.when(ok, sum(have[1:], have[0]) / len(have)))


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a Parquet table; other columns or types are refused."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    have = spark.read.parquet(path).schema if exists else None
    plain = lambda s: [(f.name, f.dataType) for f in s]
    if have is not None and plain(have) != plain(df.schema):
        raise ValueError("the table has other columns")
    df.write.mode("append").parquet(path)
