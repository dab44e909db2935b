"""Building reference tables in the order of their inputs, part by part, only where the content of inputs has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of tables that are built whole.
WHOLE = "all"


@dataclass
class Table:
    """A table made of others: ``make`` gets them by name. With ``part`` its rows of one part depend on its inputs' rows of that part alone."""

    name: str
    inputs: list[str]
    make: Callable[[dict[str, DataFrame]], DataFrame]
    part: str | None = None
    version: str = "1"  # another one rebuilds


def fingerprints(df: DataFrame, part: str | None) -> dict[str, str]:
    """Of each part the number of rows and two sums over their hashes, which don't depend on order; a row a part reaches the driver."""
    value = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit(WHOLE)
    columns = [F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)]
    rows = df.select(value.alias("p"), F.xxhash64(*columns).alias("a"), F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 40)).alias("b"))
    found = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b")).collect()
    return {r.p: f"{r.n}-{r.a}-{r.b}" for r in found}


def keys_of(table: Table, prints: dict[str, tuple[str | None, dict[str, str]]]) -> dict[str, str]:
    """What each part of a table depends on, as one digest a part. An input of other parts counts whole."""
    own = {p for name in table.inputs for p in prints[name][1] if table.part and prints[name][0] == table.part} if table.part else {WHOLE}
    out = {}
    for p in sorted(own):
        seen = [(name, prints[name][1].get(p, "") if table.part and prints[name][0] == table.part else sorted(prints[name][1].items())) for name in sorted(table.inputs)]
        out[p] = hashlib.sha256(json.dumps([table.name, table.version, seen]).encode()).hexdigest()
    return out


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """Complete manifests of a folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in found) if found else []


def current(spark: SparkSession, folder: str) -> dict[tuple[str, str], tuple[str, str]]:
    """(table, part) -> (key, path) of the last complete build; nothing before the first."""
    found = manifests(spark, folder)
    if not found:
        return {}
    return {(r.table, r.part): (r.key, r.path) for r in spark.read.schema("table string, part string, key string, path string").json(found[-1]).collect()}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last complete build."""
    paths = sorted({path for (table, _), (_, path) in current(spark, folder).items() if table == name})
    return spark.read.parquet(*paths)


def build(spark: SparkSession, sources: dict[str, tuple[DataFrame, str | None]], tables: list[Table], folder: str) -> dict[str, list[str]]:
    """Builds what has changed and says which parts of which tables that was.

    ``sources``: name -> (rows, column of their part or None); ``tables`` in
    any order. A table's part is made again if its inputs' fingerprints, its
    version or its absence ask for it; all such parts of a table are one job.
    Others keep their files. Outputs are new folders, and the manifest that
    names them is complete or not there, so readers see the last complete
    build and a failed one leaves it as it is. Parts whose inputs are gone
    leave the manifest. Inputs that nothing gives, or that go in a circle, and
    rows of a part that the inputs don't have are errors.
    """
    held = current(spark, folder)
    frames = {name: df for name, (df, _) in sources.items()}
    prints = {name: (part, fingerprints(df, part)) for name, (df, part) in sources.items()}
    fresh, made, waiting = {}, {}, list(tables)
    while waiting:
        ready = [t for t in waiting if all(i in prints for i in t.inputs)]
        if not ready:
            raise ValueError(f"nothing gives the inputs of {sorted(t.name for t in waiting)}")
        for table in ready:
            keys = keys_of(table, prints)
            stale = [p for p, key in keys.items() if held.get((table.name, p), ("", ""))[0] != key]
            entries = {p: held[table.name, p] for p in keys if p not in stale}
            if stale:
                path = f"{folder}/{table.name}/{uuid.uuid4().hex}"
                needed = {i: only(frames[i], table.part, stale) if table.part and prints[i][0] == table.part else frames[i] for i in table.inputs}
                rows = table.make(needed)
                if table.part:
                    inside = F.coalesce(F.col(table.part).cast("string"), F.lit(""))
                    known = F.when(inside.isin(stale), inside).otherwise(F.raise_error(F.concat(F.lit(f"{table.name} has rows of a part that its inputs don't have: "), inside)))
                    rows.withColumn("_part", known).write.partitionBy("_part").parquet(path)
                    entries |= {p: (keys[p], f"{path}/_part={p}" if p else f"{path}/_part=__HIVE_DEFAULT_PARTITION__") for p in stale}
                else:
                    rows.write.parquet(path)
                    entries[WHOLE] = (keys[WHOLE], path)
                made[table.name] = sorted(stale)
            there = [path for _, path in entries.values() if exists(spark, path)]
            entries = {p: e for p, e in entries.items() if e[1] in there}
            fresh |= {(table.name, p): e for p, e in entries.items()}
            frames[table.name] = spark.read.parquet(*sorted(there)) if there else table.make({i: frames[i].limit(0) for i in table.inputs})
            prints[table.name] = (table.part, fingerprints(frames[table.name], table.part))
            waiting.remove(table)
    if made or set(fresh) != set(held):
        rows = [(t, p, k, path) for (t, p), (k, path) in sorted(fresh.items())]
        spark.createDataFrame(rows, "table string, part string, key string, path string").coalesce(1).write.json(f"{folder}/manifest-{len(manifests(spark, folder)):08d}")
    return made


def only(df: DataFrame, part: str, values: list[str]) -> DataFrame:
    return df.filter(F.coalesce(F.col(part).cast("string"), F.lit("")).isin(values))


def exists(spark: SparkSession, path: str) -> bool:
    """A part that got no rows has no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
