"""Recorded discussions: responses of an issue tracker kept as JSON files, read as documents."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDED = "version int, request struct<url:string>, response struct<status:int,headers:map<string,string>,body:string>"
_BODY = "struct<title:string,body:string,html_url:string,created_at:string,updated_at:string,pull_request:struct<url:string>>"


def file_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest() + ".json"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each item of each response that was found: pages of comments are arrays, an issue is one object. Missing targets (404) are
    left out; any other status is no answer and raises when it is read."""
    raw = spark.read.schema(RECORDED).option("multiLine", "true").json(folder)
    bad = F.raise_error(F.concat(F.lit("recorded status "), F.col("response.status").cast("string"), F.lit(" for "), F.col("request.url")))
    found = raw.where("response.status <> 404").withColumn("body", F.when(F.col("response.status") == 200, F.col("response.body")).otherwise(bad.cast("string")))
    listed = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{_BODY}>")).otherwise(F.array(F.from_json("body", _BODY)))
    items = found.select(F.col("request.url").alias("url"), F.explode(listed).alias("i"))
    number = F.regexp_extract("url", r"/(?:issues|pulls)/(\d+)", 1)
    kind = F.when(F.col("url").contains("/pulls/") | F.col("i.pull_request").isNotNull(), "pr").otherwise("issue")
    body = F.coalesce("i.body", F.lit(""))
    out = items.select(F.concat_ws(":", kind, number).alias("doc_key"), kind.alias("doc_type"), number.alias("external_id"), F.col("i.html_url").alias("url"), F.to_timestamp("i.created_at").alias("created_at"), body.alias("body"), F.sha2(body, 256).alias("body_sha256"))
    return out.dropDuplicates(["doc_key", "url", "body_sha256"])


def with_retries(fetch: Callable[[], int], attempts: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """fetch's status. Raised errors and statuses from 500 on are tried again, waiting twice as long each time."""
    for k in range(attempts):
        try:
            status = fetch()
            if status < 500 or k == attempts - 1:
                return status
        except OSError:
            if k == attempts - 1:
                raise
        sleep(first_wait * 2**k)
    raise AssertionError
