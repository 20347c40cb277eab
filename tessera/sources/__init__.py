"""Tables of a directory, and files of other formats.

CSV files keep texts as they are: in text columns, a backslash, line ends, NUL
and U+0001 are written as a backslash and a letter, an empty text as \\E and a null
as \\N. So a row is always one line, Spark can split files, and nothing is
trimmed, cut at a line end or taken for a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Options that let a table come back as it was: header and quotes that CSV needs, and full timestamps.
FORMATS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"},
    "csv": {"header": "true", "escape": "\"", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quoteAll": "true"},
}
#: What stands for characters that a line can't hold, the backslash first.
MARKS = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\0": "\\0", "\1": "\\1"}


def _as_line(c: Column) -> Column:
    for char, mark in MARKS.items():
        c = F.replace(c, F.lit(char), F.lit(mark))
    return F.when(c == "", "\\E").otherwise(c)


def _from_line(c: Column) -> Column:
    """Doubled backslashes are set aside as U+0001, from left to right, so that those left begin marks; in the end the two are exchanged."""
    text = F.replace(c, F.lit("\\\\"), F.lit("\1"))
    for char in "\n\r\0":
        text = F.replace(text, F.lit(MARKS[char]), F.lit(char))
    text = F.replace(F.translate(text, "\1\\", "\\\1"), F.lit("\0011"), F.lit("\1"))
    return F.when(c == "\\E", "").otherwise(text)


def _texts(df: DataFrame, change) -> DataFrame:
    return df.withColumns({f.name: change(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory, by Spark's Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write in a format of FORMATS; by: columns that name folders, which readers then skip by."""
    if form == "csv":
        df = _texts(df, _as_line)
    df.write.format(form).options(**FORMATS[form]).mode(mode).partitionBy(*by).save(path)


def load(spark: SparkSession, path: str, form: str, like: DataFrame) -> DataFrame:
    """Read what save() wrote, with the schema of `like`, so that no pass over the files infers one."""
    df = spark.read.format(form).options(**FORMATS[form]).schema(like.schema).load(path).select(*like.columns)
    return _texts(df, _from_line) if form == "csv" else df
