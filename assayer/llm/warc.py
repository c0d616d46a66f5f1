"""Web archives: records, an offset index, and a Merkle fixity audit of replicas.

A record's bytes are hashed; hashes of ordered offset ranges make the nodes above it, level by level, up to one root for
each archive.  Replicas are compared by their roots, and only the branches of a node that differs are looked at, down to
the records that are damaged or missing.

Every level of both trees, and what differs on it, is written once and read by the next, so a plan holds one level whatever
the height.  The height follows the largest archive.  Offsets are sums over pieces of an archive (its ids, and inside an id
the first digits of the hash) and then over the records of a piece, so no window holds an archive or a hot id.

Defined cases: null html or url is empty; a null id belongs to archive -1; records that repeat id and bytes are one record
with its number of copies; records that repeat an id with other bytes stand one after the other, in the order of their
hashes; very long records make one leaf each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import discard, keep

#: Ids of one archive; bytes of the lowest offset ranges, and ranges that make the next one.
ARCHIVE_IDS, RANGE, FAN = 128, 1 << 16, 16
#: Digits of a record's hash that name its piece of an id.
PIECE_DIGITS = 4


def record_bytes(url: Column, body: Column, record_id: Column) -> Column:
    """A resource record: header lines, body and the two line ends that close it."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), record_id.cast("string"), F.lit(">\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, archive, copies, record_length, record_sha256) of the distinct records."""
    body, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    raw = record_bytes(url, body, F.coalesce(F.col("page_id"), F.lit(-1)))
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / ARCHIVE_IDS), F.lit(-1)).cast("long").alias("archive"), F.octet_length(raw).cast("long").alias("record_length"), F.sha2(F.encode(raw, "UTF-8"), 256).alias("record_sha256"))
    return rows.groupBy("page_id", "archive", "record_length", "record_sha256").agg(F.count("*").alias("copies"))


def index(found: DataFrame) -> DataFrame:
    """Records with their offset in their archive and their number in their id, in the order of ids and hashes."""
    pieced = found.withColumn("piece", F.substring("record_sha256", 1, PIECE_DIGITS))
    key = ["archive", "page_id", "piece"]
    sizes = pieced.groupBy(*key).agg(F.sum("record_length").alias("bytes"), F.count("*").alias("n"))
    in_archive, in_id = Window.partitionBy("archive").orderBy("page_id", "piece"), Window.partitionBy("archive", "page_id").orderBy("piece")
    before = sizes.select(*key, (F.sum("bytes").over(in_archive) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(in_id) - F.col("n")).alias("n_before"))
    a, b = pieced.alias("a"), before.alias("b")
    same = (F.col("a.archive") == F.col("b.archive")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.piece") == F.col("b.piece"))
    inside = Window.partitionBy("archive", "page_id", "piece").orderBy("record_sha256")
    return a.join(b, same).select("a.*", "b.bytes_before", "b.n_before").select(
        *found.columns, (F.col("bytes_before") + F.sum("record_length").over(inside) - F.col("record_length")).alias("record_offset"), (F.col("n_before") + F.row_number().over(inside)).alias("number"))


def _parent(level: int):
    """Number of the node on `level` that holds a place of the level below."""
    return F.floor(F.col("place") / (RANGE if level == 1 else FAN)).cast("long")


def _nodes(children: DataFrame, level: int) -> DataFrame:
    """Hash of each range of the level: of its children's places and hashes, in order."""
    listed = F.array_sort(F.collect_list(F.struct("place", "hash")))
    return children.groupBy("archive", _parent(level).alias("at")).agg(F.sha2(F.array_join(F.transform(listed, lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"])), "|"), 256).alias("hash")).withColumnRenamed("at", "place")


def height(*leaves: DataFrame) -> int:
    """Levels above the records after which every archive has one node."""
    last = max([x.agg(F.max("record_offset")).first()[0] or 0 for x in leaves], default=0)
    levels, top = 1, last // RANGE
    while top:
        levels, top = levels + 1, top // FAN
    return levels


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from records (place is the offset) to roots, each (archive, place, hash)."""
    out = [leaves.select("archive", F.col("record_offset").alias("place"), F.col("record_sha256").alias("hash"))]
    for k in range(1, levels + 1):
        out.append(keep(_nodes(out[-1], k), f"level{k}"))
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, record_offset, status) of the records that differ: changed, missing or extra in the replica."""
    levels = height(primary, replica)
    a, b = tree(primary, levels), tree(replica, levels)
    differ = None
    for k in range(levels, -1, -1):
        mine, theirs = a[k], b[k]
        if differ is not None:
            look = differ.select("archive", F.col("place").alias("parent"))
            mine, theirs = (x.withColumn("parent", _parent(k + 1)).join(look, ["archive", "parent"], "left_semi").drop("parent") for x in (mine, theirs))
        found = mine.withColumnRenamed("hash", "mine").join(theirs.withColumnRenamed("hash", "theirs"), ["archive", "place"], "full").where(~F.col("mine").eqNullSafe(F.col("theirs")))
        last, differ = differ, keep(found, f"differ{k}")
        if last is not None:
            discard(last)
    discard(*a[1:], *b[1:])
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return differ.select("archive", F.col("place").alias("record_offset"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: every 101st page has another first character, every 499th is lost."""
    return pages.where(F.coalesce(F.col("page_id") % 499 != 3, F.lit(True))).withColumn("html", F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of pages with its place and its state in the replica, whose records lie at the index's places."""
    own = keep(index(records(pages)), "index")
    theirs, places = index(records(replica)).alias("t"), own.alias("p")
    same = (F.col("t.archive") == F.col("p.archive")) & F.col("t.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("t.number") == F.col("p.number"))
    held = keep(theirs.join(places, same).select("p.archive", "p.record_offset", "t.record_sha256"), "replica")
    found = audit(own, held)
    return own.join(found, ["archive", "record_offset"], "left").select("page_id", "archive", "record_offset", "record_length", "record_sha256", "copies", F.coalesce("status", F.lit("intact")).alias("status"))


def parse(raw: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records of an uncompressed archive."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        out.append((at, end + 8 + n - at, headers, raw[end + 4:end + 4 + n]))
        at = end + 8 + n
    return out
