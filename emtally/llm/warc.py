"""WARC archives of pages, and a capture index made by an external merge of sorted runs.

``write_archives`` writes one gzip member per record. ``read_archives`` reads the archives back, each into
locally sorted index entries (a run). ``merge_runs`` merges the runs: the key space is cut into ranges of a bounded
number of rows that Spark deals out, and within a range a loser tree merges the runs' slices, so that the result is
ordered by URL key and timestamp over all partitions.

Pages have no time of capture. A record's date is the page_id in seconds after the start of 2024 (modulo 10^9), so the
captures of one URL are in the order of their ids.
"""

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.tables import new_path, small_batches, written

#: Bytes of compressed records after which a task begins another archive: bounds what a reader holds.
ARCHIVE_BYTES = 16 << 20
#: Captures in a range of the merge, on average: bounds what a task holds.
RANGE_ROWS = 100_000
_EPOCH = datetime.datetime(2024, 1, 1)
_MEMBER, _STEP = 1 << 16, 1 << 20

CAPTURES = "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_CAPTURE_SCHEMA = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def url_key(url: str) -> str:
    """The URL as a sort key: host labels from the right, then port, path and query; scheme, ``www.`` and fragment dropped."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host = m[1].rsplit("@", 1)[-1].lower()
    host, _, port = host.partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/").lower()


def decide(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the pages that are revisits: of equal payloads of at least
    ``min_payload_bytes`` that with the largest page_id is the response; a null page_id is the smallest, and without any
    other there is no response to revisit. A page_id with several payloads is decided for each. Only keys, URLs and
    digests are shuffled, partly summed first; the join's sides are exchanged anew, so Spark can split a digest that many
    pages share."""
    digests = _digested(pages).where(f"size >= {min_payload_bytes}").select("page_id", "url", "digest")
    last = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    kept = digests.groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).where("n > 1 AND last.page_id IS NOT NULL")
    kept = written(kept.select("digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url")), "warc-kept")
    return digests.select("page_id", "digest").join(kept, "digest").where("page_id IS NULL OR page_id < refers_to").select("page_id", "digest", "refers_to", "refers_url")


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))


def _date(page_id) -> str:
    """The page_id in seconds, modulo 10^9: a negative one has a date after those of small positive ones."""
    return (_EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _uri(url) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(page_id, url, html, refers_to, refers_url) -> bytes:
    """A record whose block is an HTTP response: of a revisit its head alone."""
    payload = (html or "").encode()
    name = "null" if page_id is None else page_id
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": _date(page_id),
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "X-Payload-Bytes": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>",
            "WARC-Refers-To-Target-URI": _uri(refers_url), "WARC-Refers-To-Date": _date(refers_to),
        }
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Writes the pages to WARC archives in the shared folder and returns their names (``archive string``),
    as a written table: it names the archives of tasks that succeeded only, so what a lost executor left
    half done is never read. A null html is an empty payload, a null url an empty one; repeated rows make
    repeated records; an empty table makes no archive. Other columns are ignored."""
    small_batches(pages.sparkSession)
    home = new_path(pages.sparkSession, "warc")
    rows, revisits = _digested(pages), decide(pages, min_payload_bytes).distinct().withColumnsRenamed({"page_id": "id", "digest": "of"})
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(home)
        store.create_dir(base, recursive=True)
        out, name, size = None, "", 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                if out is None:
                    name, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(_record(*(c[i].as_py() for c in cols))) + z.flush()
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([name])], names=["archive"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name])], names=["archive"])

    return written(rows.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(write, "archive string"), "warc-names"), home


def records(stream) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, payload) of each gzip member of a WARC stream, read a step at a time; the payload is what follows the HTTP head."""
    at, rest, step = 0, b"", True
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest:
                rest = stream.read(_STEP)
                if not rest:
                    if used:
                        raise ValueError("an archive ends within a record")
                    return
            parts.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = block[: int(headers["Content-Length"])]
        if headers["Content-Type"].startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield at, used, headers, block
        at += used


def read_archives(archives: DataFrame, home: str) -> DataFrame:
    """The captures in the archives, each archive's sorted by (url_key, timestamp, page_id): the sorted runs.
    The digest of a response's payload is computed anew and must equal the record's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(home)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = []
                with store.open_input_stream(name, compression=None) as stream:
                    for offset, length, h, payload in records(stream):
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                        if h["WARC-Type"] == "response":
                            size, again = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if again != digest:
                                raise ValueError(f"{name}: the record at {offset} has another payload than its digest says")
                        ident = lambda x: None if x == "<urn:page:null>" else int(x[10:-1])
                        stamp = re.sub(r"\D", "", h["WARC-Date"])
                        refers = ident(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                        url = h["WARC-Target-URI"]
                        found.append((url_key(url), stamp, ident(h["WARC-Record-ID"]), url, size, digest, h["WARC-Type"], refers, name, offset, length))
                found.sort(key=_order)
                for i in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[i : i + 4096]), _CAPTURE_SCHEMA)], schema=_CAPTURE_SCHEMA)

    # a number of partitions of its own: otherwise these short rows, each a whole archive to read, are put into one task
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n, "archive").mapInArrow(read, CAPTURES)


def _order(capture) -> tuple:
    return capture[0], capture[1], -1 if capture[2] is None else capture[2]


def loser_tree_merge(runs: list[Iterator], key) -> Iterator:
    """Merges sorted iterators with a loser tree: each inner node keeps the loser of the match played there,
    so the next winner needs one match per level, on the last winner's path only."""
    k = len(runs)
    done = (1,)
    heads: list = [None] * k

    def pull(i: int) -> tuple:
        for item in runs[i]:
            heads[i] = item
            return (0, key(item), i)
        return done

    keys = [pull(i) for i in range(k)]
    losers = [0] * max(1, k)

    def play(node: int) -> int:
        """The winner below ``node``; leaves are k .. 2k-1."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if keys[b] < keys[a]:
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while k and keys[winner] != done:
        yield heads[winner]
        keys[winner] = pull(winner)
        node = (winner + k) // 2
        while node and k > 1:
            if keys[losers[node]] < keys[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2


def merge_runs(captures: DataFrame, ranges: int) -> DataFrame:
    """``captures`` (a written table) in the order of (url_key, timestamp, page_id) over all partitions. There are
    ``ranges`` ranges of keys at least, and as many as keep them at RANGE_ROWS on average; archive and offset tell equal
    keys apart, so that they may be in several. A range holds slices of the runs, each in its order, as columns; slices
    are told apart by archive and by any step down within it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches], _CAPTURE_SCHEMA).combine_chunks()
        runs: dict[str, list[list]] = {}
        keys = zip(*(rows.column(c).to_pylist() for c in ("url_key", "timestamp", "page_id")))
        for i, (archive, key) in enumerate(zip(rows.column("archive").to_pylist(), map(_order, keys))):
            of = runs.setdefault(archive, [[]])
            if of[-1] and key < of[-1][-1][0]:
                of.append([])
            of[-1].append((key, i))
        order = pa.array([i for _, i in loser_tree_merge([iter(r) for of in runs.values() for r in of], lambda x: x[0])], pa.int64())
        for at in range(0, len(order), 4096):
            yield from rows.take(order[at : at + 4096]).to_batches()

    names = [f.name for f in _CAPTURE_SCHEMA]
    ranges = max(ranges, -(-captures.count() // RANGE_ROWS))
    return captures.select(*names).repartitionByRange(ranges, "url_key", "timestamp", "page_id", "archive", "offset").mapInArrow(merge, CAPTURES)


def capture_histories(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Archives the pages, reads the archives back and returns the merged, globally ordered index."""
    archives, home = write_archives(pages, min_payload_bytes)
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merge_runs(written(read_archives(archives, home), "warc-runs"), ranges)
