"""WARC archives: writing pages with revisits, reading them back, and the merged capture index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import shared_folder, written

#: The base32 alphabet of RFC 4648, the protocol lines of WARC 1.1, and the HTTP head of a page.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that an archive file holds about; a file is read back as one value.
ARCHIVE_BYTES = 32 << 20
#: Capture time of page 0 in seconds of Unix time; pages come one second apart, within the years 1970 to 9999.
EPOCH, LAST = 1704067200, 253402300799
#: Payloads from this size on are written to archives of their own; no archive file is longer than LONGEST, about.
LARGE, LONGEST = 1 << 20, 1 << 30
#: Captures of a range of the merged index, about: what one task holds.
RANGE = 1 << 18

INDEX = "url_key string, warc_date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, url string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 5 hexadecimal digits are 4 letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least min_bytes bytes, those with the largest page_id are
    responses and the others revisit it; smaller ones are all responses. Null html is an empty payload.
    A null page_id counts below every other; if no page of a payload has an id, all are responses.
    The largest id of a digest is pre-aggregated; the join back is a sort-merge join, whose skewed
    partitions (one payload on very many pages) adaptive execution splits.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    again = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d"))
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    revisit = F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")))
    joined = rows.join(again, F.col("payload_digest") == F.col("d"), "left")
    return joined.select(*rows.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("latest")).alias("refers_to"))


def record_text(rows: DataFrame) -> Column:
    """A whole WARC record but for its last line end."""
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    revisit = F.col("record_type") == "revisit"
    block_bytes = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("payload_bytes") + len(HTTP_HEAD))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    page = F.greatest(F.least(F.coalesce("page_id", F.lit(-1)), F.lit(LAST - EPOCH)), F.lit(-EPOCH))
    date = F.date_format(F.timestamp_seconds(EPOCH + page), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("WARC-Date: "), date,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"),
        F.lit(f"\r\n\r\n{HTTP_HEAD}"), F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n"),
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html; other columns are not read) as gzipped WARC files under path.

    Null html: an empty payload. Null url: no target URI. Repeated rows: a record each. An empty table: no
    records. Pages captured before 1970 or after 9999 by their ids have the dates of these limits.
    """
    rows = with_revisits(pages, min_bytes)
    n, total, most = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.max(F.octet_length("html"))).first()
    per_file = max(1, min(int(ARCHIVE_BYTES // max(1, total // max(1, n))), LONGEST // LARGE))

    def write(some: DataFrame, per_file: int, mode: str) -> None:
        lines = some.select(record_text(some).alias("value"))
        lines.write.mode(mode).option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)

    if (most or 0) < LARGE:
        write(rows, per_file, "error")
    else:
        write(rows.where(F.col("payload_bytes") < LARGE), per_file, "error")
        write(rows.where(F.col("payload_bytes") >= LARGE), max(1, LONGEST // most), "append")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, without scheme, www and fragment, in lower case."""
    rest = (url or "").split("#", 1)[0].split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    labels = host.split(":")[0].split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")/" + path


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        end = head + 4 + int(headers["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, headers, data[head + 4:end]
        at = end + 4


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def _capture_runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One locally sorted run of captures per archive; payloads are held against their digests."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            run, rows = path.rsplit("/", 1)[-1], []
            for at, head, block in records(zlib.decompress(content, 31)):
                digest, size, kind = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), head["warc-type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest:
                        raise ValueError(f"payload digest of {head['warc-record-id']} is {found}, not {digest}")
                url = head.get("warc-target-uri")
                refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
                rows.append((url_key(url), head["warc-date"], _page(head["warc-record-id"]), size, digest, kind, refers, run, at, url))
            rows.sort(key=_order)
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="Int64" if n in ("page_id", "payload_bytes", "refers_to", "offset") else object) for i, n in enumerate(names)})


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def loser_tree_merge(sorted_runs: list[list], key) -> Iterator:
    """k-way merge: inner nodes hold the loser of their match, so each row costs one path to the root."""
    k = len(sorted_runs)
    if not k:
        return
    at = [0] * k
    done = object()
    heads = [key(run[0]) if run else done for run in sorted_runs]

    def wins(a: int, b: int) -> bool:
        if heads[a] is done or heads[b] is done:
            return heads[b] is done
        return (heads[a], a) < (heads[b], b)

    tree = [-1] * k

    def play(leaf: int) -> int | None:
        """Send a run up from its leaf; the tree's root is its winner."""
        winner, node = leaf, (leaf + k) // 2
        while node:
            if tree[node] < 0:  # first round: wait here for the other side
                tree[node] = winner
                return None
            if wins(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        return winner

    best = next(w for w in [play(leaf) for leaf in range(k)] if w is not None)
    while heads[best] is not done:
        run = sorted_runs[best]
        yield run[at[best]]
        at[best] += 1
        heads[best] = key(run[at[best]]) if at[best] < len(run) else done
        best = play(best)


def _merged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted slices of all runs in one key range, merged."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).astype(object)
    rows = rows.where(rows.notna(), None)
    runs: dict[str, list[tuple]] = {}
    for row in rows.itertuples(index=False, name=None):
        runs.setdefault(row[7], []).append(row)
    out = pd.DataFrame(list(loser_tree_merge(list(runs.values()), _order)), columns=rows.columns)
    yield out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to", "offset")})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under path, one row per record, in runs sorted by archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_capture_runs, INDEX)


def merge_index(index: DataFrame) -> DataFrame:
    """The globally ordered capture histories: by URL key, then time, then page.

    External merge: the sorted runs are cut at common quantiles of the whole key (so that a URL with very
    many captures is cut by time, and equal captures by archive), into ranges of about RANGE captures,
    however many there are; in each range the slices of all runs, sorted as they are, go through a loser tree.
    An empty index gives no rows.
    """
    key = ["url_key", "warc_date", "page_id", "run", "offset"]
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // RANGE)
    return index.repartitionByRange(ranges, *key).sortWithinPartitions("run", *key).mapInPandas(_merged, INDEX)


def capture_histories(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write WARC archives of pages into the shared folder, read them back, merge their index.

    Null url: the record has no target URI and its key is ')/'. Null html: an empty payload. Repeated
    rows each are a record of their own. Extra columns of pages are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes)
    return merge_index(written(read_index(spark, path), "warc-index"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged capture index of all pages, read back from the archives: edge cases as for capture_histories()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return capture_histories(pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date", "run", "offset")
