"""The lexer and the scan as functions for SQL: sql_tokens, sql_facts, sql_findings, sql_quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..options import ScanOptions
from .lex import lex, quality
from .scan_text import scan_text


def register(spark: SparkSession, options: ScanOptions = ScanOptions.metadata()) -> None:
    """Registers Arrow-batched functions of a text column."""

    @F.pandas_udf("array<struct<type:string,text:string,line:int,start:int,stop:int>>")
    def sql_tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"type": x.type, "text": x.text, "line": x.line, "start": x.start, "stop": x.stop} for x in lex(t or "")[0] if not x.hidden])

    @F.pandas_udf("array<array<string>>")
    def sql_facts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [i["facts"] for i in scan_text(t or "", options)["identities"]])

    @F.pandas_udf("array<struct<column_name:string,operator:string,value:string,line:int>>")
    def sql_findings(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{k: f[k] for k in ("column_name", "operator", "value", "line")} for f in scan_text(t or "", options)["findings"]])

    @F.pandas_udf("string")
    def sql_quality(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (quality(*lex(t or "")) or (None,))[0])

    for name, f in (("sql_tokens", sql_tokens), ("sql_facts", sql_facts), ("sql_findings", sql_findings), ("sql_quality", sql_quality)):
        spark.udf.register(name, f)
