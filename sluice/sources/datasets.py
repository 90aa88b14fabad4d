"""Reading: parquet datasets, warehouse views, parameterised SQL, foreign files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DATASET

# Accepted names of each logical column in foreign transfer files.
COLUMN_ALIASES = {
    "src": ("src", "sender", "from_account", "orig_acct", "nameOrig", "source"),
    "dst": ("dst", "receiver", "to_account", "bene_acct", "nameDest", "target"),
    "amount": ("amount", "base_amt", "amt", "TransactionAmt", "value"),
    "timestamp": ("timestamp", "tran_timestamp", "step", "time", "date"),
    "label": ("is_sar", "isFraud", "is_fraud", "label", "is_laundering"),
}
STEP_SECONDS = 3600
TRUE_LABELS = ("1", "true", "sar", "1.0", "yes")


def missing_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            gone.append(p)
    return gone


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four canonical tables; one error names every missing file."""
    paths = {name: f"{folder}/{name}.parquet" for name in DATASET}
    gone = missing_files(spark, list(paths.values()))
    if gone:
        raise FileNotFoundError("missing dataset files: " + ", ".join(sorted(gone)))
    return {name: spark.read.schema(DATASET[name]).parquet(p) for name, p in paths.items()}


def register_warehouse(accounts: DataFrame, transfers: DataFrame, labels: DataFrame) -> None:
    """Temp views of the tables plus ``account_facts`` and ``retail_accounts``."""
    accounts.createOrReplaceTempView("accounts")
    transfers.createOrReplaceTempView("transfers")
    labels.createOrReplaceTempView("mule_labels")
    account_facts(accounts, labels).createOrReplaceTempView("account_facts")
    accounts.where("archetype <> 'exit_point'").createOrReplaceTempView("retail_accounts")


def account_facts(accounts: DataFrame, labels: DataFrame) -> DataFrame:
    """Accounts left-joined to labels; unlabelled accounts take the neutral values."""
    return accounts.join(labels, "account", "left").select(
        *accounts.columns,
        F.coalesce("is_mule", F.lit(False)).alias("is_mule"),
        F.coalesce("ring_id", F.lit("")).alias("ring_id"),
        F.coalesce(F.col("layer_index"), F.lit(-1)).alias("layer_index"),
        F.coalesce("is_cashout_node", F.lit(False)).alias("is_cashout_node"),
        F.coalesce("typology", F.lit("")).alias("typology"),
    )


def rollup(spark: SparkSession, sql: str, args: list) -> DataFrame:
    """SQL with positional parameters over the registered views."""
    return spark.sql(sql, args=args)


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    found, lacking = {}, []
    for logical, names in COLUMN_ALIASES.items():
        hit = next((c for c in names if c in columns), None)
        if hit is None:
            lacking.append(logical)
        else:
            found[logical] = hit
    if lacking:
        raise ValueError(f"no column for {lacking}; file has {sorted(columns)}")
    return found


def load_foreign_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Transfers of a foreign CSV as ``src, dst, amount, epoch, is_sar``."""
    raw = spark.read.csv(path, header=True)
    at = resolve_columns(raw.columns)
    time = F.col(at["timestamp"])
    epoch = F.coalesce(
        F.expr(f"try_cast(`{at['timestamp']}` AS bigint)") * STEP_SECONDS,
        F.unix_timestamp(F.try_to_timestamp(time)),
    )
    return raw.select(
        F.col(at["src"]).alias("src"),
        F.col(at["dst"]).alias("dst"),
        F.expr(f"try_cast(`{at['amount']}` AS double)").alias("amount"),
        epoch.alias("epoch"),
        F.lower(F.trim(F.col(at["label"]))).isin(*TRUE_LABELS).alias("is_sar"),
    ).dropna(subset=["src", "dst", "amount", "epoch"])


def load_edge_list(edges: DataFrame, order: str) -> DataFrame:
    """String ids, unparsable amounts -> 1.0, and the last row of each pair kept."""
    amount = F.coalesce(F.expr("try_cast(amount AS double)"), F.lit(1.0))
    return (
        edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"),
                     amount.alias("amount"), F.col(order).alias("__o"))
        .groupBy("source", "target")
        .agg(F.max_by("amount", "__o").alias("amount"))
    )


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All listed nodes with their degrees; isolated nodes stay with zero."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (
        nodes.select(F.col("node").cast("string").alias("node"))
        .join(out, "node", "left").join(inn, "node", "left").fillna(0, ["out_degree", "in_degree"])
    )


def merge_identity(cards: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Left merge on the transaction id; without identity the device fields are null."""
    if identity is None:
        return cards.withColumn("device_type", F.lit(None).cast("string")).withColumn("device_info", F.lit(None).cast("string"))
    return cards.join(identity, "transaction_id", "left")


def latest_row(df: DataFrame, at: str, *columns: str) -> DataFrame:
    """The newest row, found in one pass without a sort."""
    top = df.agg(F.max_by(F.struct(*columns), F.col(at)).alias("r"))
    return top.select("r.*")
