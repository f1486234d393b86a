"""Content-addressed archive of WARC records: payloads once by digest, headers apart, records by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.bloom import may_repeat, members
from basketry.llm.common import attach_groups, keyed, staged

# Fixed values of the record format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


@dataclass
class Archive:
    """``headers`` (rid, sha256, header): one row a record, the header's exact bytes. ``payloads`` (sha256, copies,
    payload): one row per distinct payload."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four groups of 40, eight letters each, so there is no padding."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")


def _record_id(page: Column, rid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), rid.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write one record per row; records with equal payloads of at least ``min_bytes`` refer to the first of them.

    The first is the one with the smallest page_id, null ids last; of rows equal in both, one. Payloads are equal if
    their SHA-256 is. Null html counts as empty; a null url leaves its field out; line ends in a url are escaped.
    Headers alone are grouped; a payload is shuffled only if a filter finds that it may be a later copy. Record ids hold
    the page_id and a number of the row, so rows that share a page_id are records of their own.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    full = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    meta = keyed(full.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")))
    meta = staged(meta.withColumnRenamed("_rid", "rid"), "warc-meta")
    n = meta.count()
    groups = meta.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("top"), F.count(F.lit(1)).alias("copies"))
    groups = staged(groups, "warc-groups")
    rows = attach_groups(meta, groups, "sha256", "copies", n).withColumn("first", F.col("top.rid") == F.col("rid"))
    revisit = ~F.col("first") & (F.col("bytes") >= min_bytes)
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("rid"))),
        _field("WARC-Target-URI", address), _field("WARC-Date", F.lit(date)), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("top.page_id"), F.col("top.rid")))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))), F.lit(END),
    )
    headers = staged(rows.select("rid", "sha256", "first", "page_id", header.cast("binary").alias("header")), "warc-headers")
    key = F.xxhash64("page_id", "sha256")
    later = headers.filter("not first").select(key.alias("key"))
    bits = members(later, "key")
    maybe = may_repeat(bits, F.col("key"), spark)
    marked = full.select("page_id", "sha256", "payload", key.alias("key")).withColumn("maybe", maybe)
    firsts = groups.filter("copies > 1").select(F.col("sha256").alias("_sha"), F.col("top.page_id").alias("_page"))
    alone = groups.filter("copies = 1").select(F.col("sha256").alias("_sha"), F.col("top.page_id").alias("_page"))
    firsts = firsts.unionByName(alone.filter(may_repeat(bits, F.xxhash64("_page", "_sha"), spark)))
    doubtful = marked.filter("maybe").join(firsts, (F.col("sha256") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_page"))).select("sha256", "payload").dropDuplicates(["sha256"])
    store = staged(marked.filter("not maybe").select("sha256", "payload").unionByName(doubtful), "warc-payloads")
    return Archive(headers.drop("first", "page_id"), store)


def _checked(payloads: DataFrame) -> DataFrame:
    """Payloads whose bytes still have the digest they are stored under; any other stops the query."""
    ok = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return payloads.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")))


def header_field(name: str, header: Column) -> Column:
    """A field's value in a header, null without it."""
    found = F.regexp_extract(header.cast("string"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def reconstruct(archive: Archive) -> DataFrame:
    """(rid, record): the original records, byte by byte: each response's header, its payload and the closing line ends;
    revisits have no payload.

    A response finds its payload by the digest that both are stored under. Only payloads below the writer's bound have
    more than one response; where these are very many, the payload goes to them.
    """
    revisit = header_field("WARC-Type", F.col("header")) == "revisit"
    end = F.lit((END * 2).encode())
    responses = archive.headers.filter(~revisit)
    copies = responses.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    payloads = _checked(archive.payloads).join(copies, "sha256")
    joined = attach_groups(responses, payloads, "sha256", "copies", archive.headers.count())
    alone = archive.headers.filter(revisit).select("rid", F.concat("header", end).alias("record"))
    return joined.select("rid", F.concat("header", "payload", end).alias("record")).unionByName(alone)


def parse_records(records: DataFrame) -> DataFrame:
    """(rid, header, payload) of ``records`` (rid, record): the header ends at the first empty line, the payload has as
    many bytes as Content-Length says, and two line ends close the record; any other form stops the query."""
    head = F.concat(F.substring_index(F.col("record").cast("string"), END * 2, 1), F.lit(END * 2)).cast("binary")
    cut = records.select("rid", "record", head.alias("header"))
    cut = cut.withColumn("at", F.octet_length("header")).withColumn("n", header_field("Content-Length", F.col("header")).cast("int"))
    whole = (F.octet_length("record") == F.col("at") + F.col("n") + 4) & F.col("header").cast("string").startswith("WARC/1.1" + END)
    payload = F.expr("substring(record, at + 1, n)")
    return cut.select("rid", "header", F.when(whole, payload).otherwise(F.raise_error(F.lit("not a whole record")).cast("binary")).alias("payload"))


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row a record, from the rebuilt records.

    Length and digest of a response are those of the payload in its record, and must be what the header says. A revisit
    gets the length from the response whose digest it names.
    """
    parsed = parse_records(reconstruct(archive))
    field = lambda name: header_field(name, F.col("header"))
    page = lambda name: F.regexp_extract(field(name), "<urn:page:(-?\\d+):", 1).try_cast("long")
    said = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    kind = field("WARC-Type")
    agrees = (kind == "revisit") | (said == base32_sha1(F.col("payload")))
    rows = staged(parsed.select(
        page("WARC-Record-ID").alias("page_id"), F.when(kind == "response", F.octet_length("payload").cast("long")).alias("own_bytes"),
        F.when(agrees, said).otherwise(F.raise_error(F.lit("a header disagrees with its payload"))).alias("payload_digest"),
        kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    ), "warc-read")
    known = rows.groupBy("payload_digest").agg(F.max("own_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("copies"))
    found = attach_groups(rows, staged(known, "warc-known"), "payload_digest", "copies", rows.count())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('{BASE32}', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * j + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
