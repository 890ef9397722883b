"""Writers: splits, folds, instruction items in two shapes, reports, and resumable batches."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import cut

# the writer would trim blanks at both ends of a text
CSV = {"header": True, "quote": '"', "escape": '"', "quoteAll": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def join(folder: str, name: str) -> str:
    """A path below a folder of any file system."""
    return f"{folder.rstrip('/')}/{name}"


def save_splits(df: DataFrame, folder: str, fmt: str = "csv", column: str = "split", single_file: bool = False) -> None:
    """One folder for each value of ``column``; as single files only where asked for."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite").partitionBy(column)
    out.options(**(CSV if fmt == "csv" else {})).format(fmt).save(folder)


def project_lists(sides: DataFrame, project: str = "project") -> DataFrame:
    """(fold, side, n_projects, projects): sorted names of each side of each fold."""
    return sides.groupBy("fold", "side").agg(F.sort_array(F.collect_set(project)).alias("projects")).select("fold", "side", F.size("projects").alias("n_projects"), "projects")


def project_list_text(fold: int, train: list[str], test: list[str]) -> str:
    """The text of a fold's project list."""
    # The two headings.
    parts = [("训练集项目", train), ("测试集项目", test)]
    return "\n\n".join("\n".join([f"{head} ({len(names)}):", *(f"  {n}" for n in names)]) for head, names in parts) + "\n"


def save_folds(sides: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Rows of every fold by ``fold`` and ``side`` (train, test), in folders fold=i/side=s, and a list of
    each fold's projects in fold_i_projects. Only names of projects reach the driver."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    sides.write.mode("overwrite").partitionBy("fold", "side").options(**(CSV if fmt == "csv" else {})).format(fmt).save(folder)
    names: dict[int, dict[str, list[str]]] = {}
    for r in project_lists(sides.filter("project is not null")).collect():
        names.setdefault(r.fold, {})[r.side] = r.projects
    for fold, by in sorted(names.items()):
        save_text(sides.sparkSession, join(folder, f"_lists/fold_{fold}_projects"), project_list_text(fold, by.get("train", []), by.get("test", [])))


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file in the folder ``path``."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def json_document(df: DataFrame, order: str) -> DataFrame:
    """One JSON array of all rows by ``order``; for results of known small size."""
    rows = df.select(F.struct(F.col(order), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("r"))
    return rows.agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["col2"]), ",\n"), F.lit("\n]")).alias("value"))


def save_json(df: DataFrame, path: str, lines: bool = True, order: str | None = None) -> None:
    """JSON lines; with ``lines`` false one array, which one task has to hold. NaN is written as null."""
    clean = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    if lines:
        clean.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        json_document(clean, order or clean.columns[0]).coalesce(1).write.mode("overwrite").text(path)


def plain_items(items: DataFrame) -> DataFrame:
    return items.select("instruction", "input", "output")


def save_items(items: DataFrame, folder: str, name: str, with_retrieval: bool) -> None:
    """The plain items, and with retrieval also those with id and examples. The items are written
    once before, so that no model is called twice. Where there is a ``row_index``, the files are in its
    order."""
    held = cut(items, "items")
    if "row_index" in held.columns:
        held = held.orderBy("row_index").drop("row_index")
    if with_retrieval:
        save_json(held, join(folder, f"{name}_external"))
    save_json(plain_items(held), join(folder, name))


def resume(df: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], key: str = "id", batches: int = 10) -> DataFrame:
    """``step`` over the rows of ``df``, in batches by hash of the key that are appended to a table in
    ``folder``; rows whose key is there already are left out, so a broken run goes on where it was."""
    spark = df.sparkSession

    def done() -> DataFrame | None:
        try:
            return spark.read.parquet(folder)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return None

    for b in range(batches):
        part = df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        if (have := done()) is not None:
            part = part.join(have.select(key), key, "left_anti")
        step(part).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
