"""An editor's session as relations: messages become versions of documents, the newest open ones are looked at, and findings become messages again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.versions import latest

MESSAGE = "method string, params struct<textDocument:struct<uri:string,version:long,text:string>,contentChanges:array<struct<text:string>>>"
OPEN, CHANGE, CLOSE = "textDocument/didOpen", "textDocument/didChange", "textDocument/didClose"


def updates(messages: DataFrame) -> DataFrame:
    """session, ord, uri, version, text, closed of the messages (session, ord, body) that change a document; of a change's several texts the last counts."""
    m = messages.withColumn("m", F.from_json("body", MESSAGE)).filter(F.col("m.method").isin(OPEN, CHANGE, CLOSE))
    changes = F.col("m.params.contentChanges")
    text = F.when(F.col("m.method") == CHANGE, F.try_element_at(changes, F.lit(-1))["text"]).otherwise(F.col("m.params.textDocument.text"))
    return m.select("session", "ord", F.col("m.params.textDocument.uri").alias("uri"), F.col("m.params.textDocument.version").alias("version"), text.alias("text"), (F.col("m.method") == CLOSE).alias("closed")).filter("uri is not null")


def open_documents(changed: DataFrame) -> DataFrame:
    """session, uri, version, text of documents that are open: the last message about each decides. A version that isn't newer than one
    seen since the document was opened is passed over; once closed, a document's versions begin anew."""
    from pyspark.sql import Window

    before = Window.partitionBy("session", "uri").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    turned = changed.withColumn("turn", F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0)))
    since = Window.partitionBy("session", "uri", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    fresh = turned.withColumn("seen", F.max("version").over(since)).filter(F.col("closed") | F.col("seen").isNull() | (F.col("version") > F.col("seen")))
    keyed = fresh.withColumn("key", F.struct("session", "uri"))
    return latest(keyed, "key", "ord", "version", "text", "closed").filter("not closed").select("key.session", "key.uri", "version", "text")


def diagnostics(documents: DataFrame, severities: dict[str, str]) -> DataFrame:
    """session, uri, version, n, message: what to tell the editor about every open document, also where there is nothing left to find."""
    from tessera.sources import gofiles

    files = documents.select(F.concat_ws("\n", "session", "uri").alias("path"), F.encode("text", "UTF-8").alias("bytes"))
    found = gofiles.lint(files, severities).filter("disposition = 'visible'")
    items = found.groupBy("path").agg(F.collect_list(F.struct("start", "end", "rule_id", "severity", F.col("message_key").alias("message"))).alias("items"))
    met = documents.withColumn("path", F.concat_ws("\n", "session", "uri")).join(items, "path", "left")

    @F.pandas_udf("string")
    def message(uri, version, text, own):
        import json

        import pandas as pd

        from tessera.streaming.framing import published

        return pd.Series([json.dumps(published(u, int(v), t, [] if f is None else list(f)), ensure_ascii=False) for u, v, t, f in zip(uri, version, text, own, strict=True)])

    return met.select("session", "uri", "version", F.coalesce(F.size("items"), F.lit(0)).alias("n"), message("uri", "version", "text", "items").alias("message"))
