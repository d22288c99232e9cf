"""Reading and writing tables of text columns: dialects, headers, typed schemas, row ids, index tables."""

from __future__ import annotations

import csv
import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .shared import stored

# fixed values
ENCODINGS, SEPARATORS, SNIFF_LINES = ("utf-8", "ISO-8859-1", "windows-1252"), (";", ",", "\t"), 3000
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EXTENSIONS = ("csv", "xls", "xlsx")
# end of fixed values


def clean_header(name: str) -> str:
    return re.sub(r"[()\\/\"']", "_", name)


def check_header(names: list[str]) -> list[str]:
    """Cleaned names; double underscores are reserved and names have to be unique and at least one."""
    out = [clean_header(n) for n in names]
    if not out:
        raise ValueError("a table needs a column")
    if bad := [n for n in out if "__" in n]:
        raise ValueError(f"reserved column names: {bad}")
    if len(set(out)) < len(out):
        raise ValueError("column names have to be unique")
    return out


def check_extension(path: str) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in EXTENSIONS:
        raise ValueError(f"no reader for .{kind}")
    return kind


def sniff(lines: bytes) -> tuple[str, str]:
    """(encoding, separator) out of a file's first bytes: the first encoding that decodes, its separator of most columns."""
    for encoding in ENCODINGS:
        try:
            head = lines.decode(encoding).splitlines()[:SNIFF_LINES]
        except UnicodeDecodeError:
            continue
        best, most = SEPARATORS[0], 0
        for sep in SEPARATORS:
            widths = [len(r) for r in csv.reader(head, delimiter=sep)]
            # rows wider than the header don't rule a separator out, they only can't speak for it
            if widths and widths[0] >= most and 2 * sum(w <= widths[0] for w in widths) >= len(widths):
                best, most = sep, widths[0]
        if most:
            return encoding, best
    raise ValueError("no encoding fits")


def sniff_file(spark: SparkSession, path: str) -> tuple[str, str]:
    """sniff over the first MB of a file that Spark can reach."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 20)))
    finally:
        stream.close()
    cut = data.rfind(b"\n") + 1 if len(data) == 1 << 20 else len(data)
    return sniff(data[:cut])


def schema_for(columns: list[str]) -> StructType:
    """Types by name: flags, scores and ids of links; all else is text."""
    def kind(c: str):
        if "__MODIFIED" in c or c == "__IS_MATCH":
            return BooleanType()
        if c in ("__CONFIDENCE", "__ES_SCORE", "__THRESH", "__ID_QUERY"):
            return DoubleType()
        return StringType()

    return StructType([StructField(c, kind(c)) for c in columns])


def has_broken_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes on in the next line: such a line has an odd number of quotes. Stops at the first one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None, na_strings: tuple[str, ...] = ("",), multi_line: bool | None = None) -> DataFrame:
    """A CSV file with text columns and a cleaned header; na_strings become null. multi_line: whether quoted cells hold
    line ends; by default that is looked for, since a file is read in many tasks only where they don't."""
    if encoding is None or sep is None:
        encoding, sep = sniff_file(spark, path)
    if multi_line is None:
        multi_line = has_broken_cells(spark, path)
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    df = df.toDF(*check_header(df.columns))
    extra = [n for n in na_strings if n]
    return df.select(*[F.when(~F.col(c).isin(*extra), F.col(c)).alias(c) for c in df.columns]) if extra else df


def read_typed(spark: SparkSession, path: str, columns: list[str], selected: list[str] | None = None, n_rows: int | None = None, na_strings: tuple[str, ...] = ("",)) -> DataFrame:
    """A CSV table of this engine: types by column names, only the selected columns, the first n_rows if given."""
    df = spark.read.schema(schema_for(columns)).csv(path, header=True, quote='"', escape='"', multiLine=has_broken_cells(spark, path))
    df = df.select(*(selected or columns))
    extra = [n for n in na_strings if n]
    if extra:
        df = df.select(*[F.when(~F.col(c).isin(*extra), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df.limit(n_rows) if n_rows is not None else df


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """An Excel sheet (files of one machine's size), all columns as text; needs a reader library for pandas."""
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    pdf.columns = check_header([str(c) for c in pdf.columns])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema_for(list(pdf.columns)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, label): stripped, non-empty lines of a lexicon."""
    from ..functions.text import stripped

    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), stripped("value").alias("label")).where("label != ''")


def read_column(spark: SparkSession, path: str, column: int = 0, sep: str = "|", valid=None) -> DataFrame:
    """(label) from one column of a delimited lexicon file, with an optional filter on it."""
    df = spark.read.csv(path, sep=sep, header=False)
    out = df.select(F.col(df.columns[column]).alias("label")).where("label is not null")
    return out.where(valid(F.col("label"))) if valid else out


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """(line, forms): main|variant|variant rows."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", r"\|").alias("forms"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Contiguous ids from 0 in file order: counts of the partitions, then positions in them.

    The rows are read twice. A plan of scans and row maps gives them alike both times; any other, whose partitions come
    out of a shuffle, is stored first.
    """
    spark = df.sparkSession
    if any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Scan ExistingRDD", "Sample")):
        df = stored(df, "rows")
    placed = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    before = spark.createDataFrame(starts, StructType([StructField("_p", LongType()), StructField("_s", LongType())]))
    return placed.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_s") + F.col("_i")).alias(name))


def ingest(df: DataFrame) -> tuple[DataFrame, dict]:
    """A checked table with row ids, and what is known of it."""
    out = with_row_id(df.toDF(*check_header(df.columns)))
    return out, {"columns": out.columns[:-1], "ncols": len(out.columns) - 1, "nrows": out.count()}


def select_columns(df: DataFrame, columns: list[str], with_flags: bool = True) -> DataFrame:
    """The selected columns with their modification flags."""
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    flags = [f"{c}__MODIFIED" for c in columns if with_flags and f"{c}__MODIFIED" in df.columns]
    return df.select(*columns, *flags)


def without_flags(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if "__MODIFIED" not in c])


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """Writes a table that isn't there yet and returns its number of rows; without rows it is an error and none is left."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    (out.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"') if kind == "csv" else out.write.mode("errorifexists").parquet(path))
    if not seen.get["n"]:
        remove(df.sparkSession, path)
        raise ValueError("no rows were written")
    return seen.get["n"]


def pad_rows(rows: list[list[str]]) -> list[list[str]]:
    """Rows of one width: short ones get empty cells."""
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def secure_name(name: str) -> str:
    """A file name without folders and signs: ASCII letters, digits, `_`, `-` and inner full stops."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    out = re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(re.split(r"[\s/\\]+", plain))).strip("._")
    if not out:
        raise ValueError("a file needs a name")
    return out


def export(df: DataFrame, path: str, step: str, thresh: float = 1.0, compressed: bool = False) -> str:
    """A result as CSV files below path; links under the threshold are nulled first. The raw upload isn't exported."""
    from ..operators.link import null_below

    if step == "INIT":
        raise ValueError("only results are exported")
    out = null_below(df, thresh) if "__CONFIDENCE" in df.columns and "__IS_MATCH" in df.columns else df
    folder, _, name = path.rstrip("/").rpartition("/")
    target = f"{folder + '/' if folder else ''}{secure_name(name)}_MMM.csv"
    out.write.mode("errorifexists").csv(target, header=True, quote='"', escape='"', compression="gzip" if compressed else "none")
    return target


class Index:
    """A stored result or reference table with its token table and a manifest that tells whether it is up to date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/manifest"))

    def manifest(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])

    def delete(self) -> None:
        if self.exists() and self.manifest().get("no_delete"):
            raise ValueError("this index is not to be deleted")
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def build(self, df: DataFrame, row_id: str, columns: dict[str, tuple[str, ...]], force: bool = False, no_delete: bool = False) -> bool:
        """Builds rows, terms and manifest unless a current index is there; tells whether it built."""
        from ..operators.link import postings

        n, content = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()
        asked = {c: sorted(a) for c, a in columns.items()}
        if not force and self.exists():
            known = self.manifest()
            if known["n_rows"] == n and known.get("content") == content and all(set(a) <= set(known["columns"].get(c, ())) for c, a in asked.items()):
                return False
        fs, path = self._fs()
        fs.delete(path(self.path), True)
        df.write.parquet(f"{self.path}/rows")
        postings(df, row_id, columns).write.parquet(f"{self.path}/terms")
        manifest = json.dumps({"n_rows": n, "content": content, "row_id": row_id, "columns": asked, "no_delete": no_delete})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{self.path}/manifest")
        return True

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")


def upsert(df: DataFrame, changed: DataFrame, row_id: str) -> DataFrame:
    """df with the rows of changed in place of those of the same id, new ones added."""
    return df.join(changed.select(row_id), row_id, "left_anti").unionByName(changed.select(*df.columns))
