"""Readers: corpora (CSV), instruction items (JSON), predictions, truth, prompts, run configurations."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.answers import extract_answer, normalize_category, truth_category, truth_verdict
from siftline.operators.metrics import last_by_id
from siftline.operators.ordering import with_position

CORPUS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("project", T.StringType()), ("test_name", T.StringType()), ("full_code", T.StringType()), ("label", T.StringType()), ("category", T.IntegerType()))])
SHOT = T.StructType([T.StructField(n, t) for n, t in (("similarity", T.DoubleType()), ("project", T.StringType()), ("test_name", T.StringType()), ("label", T.StringType()), ("code_preview", T.StringType()), ("id", T.LongType()))])
ITEM = T.StructType([T.StructField(n, t) for n, t in (("instruction", T.StringType()), ("input", T.StringType()), ("output", T.StringType()), ("id", T.LongType()), ("few_shot_examples", T.ArrayType(SHOT)))])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS, encoding: str = "UTF-8", line_end: str | None = None) -> DataFrame:
    """A CSV corpus whose texts hold line breaks and doubled quotes; an empty field is null. The
    header names the columns, so their order in the file is free; one that is missing is an error.
    Where the rows' ``line_end`` is given, line breaks in texts stay as they are; else they become \\n."""
    opts = ({"lineSep": line_end} if line_end else {}) | {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": encoding, "enforceSchema": False}
    header = spark.read.options(**opts).csv(path).columns
    wanted = {f.name: f for f in schema}
    if missing := [n for n in wanted if n not in header]:
        raise ValueError(f"columns missing in {path}: {missing}")
    full = T.StructType([wanted.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.options(**opts).schema(full).csv(path).select(*wanted)


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Instruction items of a JSON document (one array or one object), or of JSON lines, which can be split."""
    return spark.read.option("multiLine", not lines).schema(ITEM).json(path)


def code_column(df: DataFrame, wanted: str = "code") -> str:
    """The wanted column, else ``full_code``: chosen by the columns, not by values."""
    for c in (wanted, "full_code"):
        if c in df.columns:
            return c
    raise ValueError("no code column")


def predictions_from_items(items: DataFrame, order: str, text: str = "output") -> DataFrame:
    """(id, is_flaky, category) from model texts: an item without id takes its position by ``order``;
    texts without verdict are dropped, though they take up a position; of one id the last counts."""
    parsed = with_position(items.select(order, F.col("id").cast("bigint").alias("id"), extract_answer(F.col(text)).alias("a")), [order], "pos")
    kept = parsed.filter("a.is_flaky is not null and a.category is not null")
    return last_by_id(kept.select(F.coalesce("id", "pos").alias("id"), "pos", "a.is_flaky", normalize_category(F.col("a.category")).alias("category")), "pos")


def truth_from_labels(df: DataFrame, label: str = "label", key: str = "id", order: str | None = None) -> DataFrame:
    """(id, is_flaky, category) of labelled rows; of one id the last counts: by the column ``order``, or
    in the order of the scanned files where there is none."""
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    rows = df.select(F.col(key).alias("id"), F.struct(place).alias("_order"), truth_verdict(F.col(label)).alias("is_flaky"), truth_category(F.col(label)).alias("category"))
    return last_by_id(rows, "_order")


def file_names(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of a folder's files with the suffix, sorted, on any file system Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(suffix))


def list_datasets(spark: SparkSession, folder: str, main: str = "dataset.csv") -> list[str]:
    """CSV files of a folder: the main one, then the fold files by name, then the others by name."""
    names = file_names(spark, folder, ".csv")
    return [n for n in names if n == main] + [n for n in names if n.startswith("fold_")] + [n for n in names if n != main and not n.startswith("fold_")]


def list_prediction_files(spark: SparkSession, folder: str) -> list[str]:
    """``*_external.json`` files, or all JSON files where there are none."""
    names = file_names(spark, folder, ".json")
    return [n for n in names if n.endswith("_external.json")] or names


def load_prompt(folder: str, name: str) -> str:
    return Path(folder, f"{name}.txt").read_text("utf-8").strip()


def save_prompt(folder: str, name: str, text: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{name}.txt").write_text(text, "utf-8")


def load_env(path: str) -> dict[str, str]:
    """NAME=value lines of a file, set in the environment where they are not yet; # begins a comment."""
    found = {}
    for line in Path(path).read_text("utf-8").splitlines() if Path(path).exists() else []:
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
            os.environ.setdefault(name.strip(), found[name.strip()])
    return found


@dataclass
class RunConfig:
    task_type: str = "distillation"
    test_dataset: str = ""
    train_dataset: str | None = None
    use_api_matching: bool = False
    top_k_shots: int = 3
    mode: str = "all"
    test_size: int | None = None
    parallel_workers: int = 1
    batch_size: int = 50

    def __post_init__(self) -> None:
        self.top_k_shots = min(10, max(1, self.top_k_shots))
        self.parallel_workers = min(10, max(1, self.parallel_workers))

    @property
    def output_name(self) -> str:
        """Name of the run's outputs, joined by underscores."""
        parts = [Path(self.test_dataset).stem, f"top{self.top_k_shots}" if self.use_api_matching else "", self.mode, str(self.test_size) if self.test_size else ""]
        return "_".join(p for p in parts if p)


def save_config(folder: str, name: str, config: RunConfig) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{name}.json").write_text(json.dumps(asdict(config), ensure_ascii=False, indent=2), "utf-8")


def load_config(folder: str, name: str) -> RunConfig:
    return RunConfig(**json.loads(Path(folder, f"{name}.json").read_text("utf-8")))


def display_config(config: RunConfig) -> str:
    """One line for each setting."""
    return "\n".join(f"{k}: {'-' if v is None else v}" for k, v in asdict(config).items())


def list_configs(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def delete_config(folder: str, name: str) -> bool:
    at = Path(folder, f"{name}.json")
    if at.exists():
        at.unlink()
        return True
    return False
