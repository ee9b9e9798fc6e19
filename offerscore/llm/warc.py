"""WARC derivative builder: metadata and plain-text conversion records from responses.

Each response record (WARC/1.0 or 1.1 bytes, headers and HTTP message) gives two records
that refer to it: a *metadata* record that lists the source's WARC and HTTP headers,
digests and decoding, and a *conversion* record with its page as plain text.  Both keep the
source's target, date and payload digest, and have identifiers derived from the source's,
so that repeated work gives the same records.  Records are independent: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Source headers that derived records carry on.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # fixed value: the URL namespace
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|time|u|var|wbr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


class Malformed(ValueError):
    """A record that cannot be read."""


def split_headers(data: bytes) -> tuple[bytes, list[tuple[str, str]], bytes]:
    """First line, headers in order (continuation lines joined) and the rest."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        raise Malformed("no end of headers")
    lines = head.split(b"\r\n")
    out: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Malformed("a header without a colon")
        out.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    return lines[0], out, rest


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one WARC record; the block has exactly Content-Length bytes."""
    first, headers, rest = split_headers(record)
    if not first.startswith(b"WARC/"):
        raise Malformed("not a WARC record")
    length = header(headers, "Content-Length") or ""
    if not length.isdigit() or int(length) > len(rest):
        raise Malformed("a wrong Content-Length")
    return headers, rest[:int(length)]


def digest_ok(label: str | None, data: bytes) -> bool | None:
    """Whether a labelled digest (sha1, sha256, md5; base32 or hex) holds; None if absent or unknown."""
    kind, colon, value = (label or "").partition(":")
    if not colon or kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    raw = hashlib.new(kind.lower(), data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def payload_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, HTTP headers, the payload as sent, and decoded from its transfer and
    content encodings as far as they can be read."""
    status, headers, sent = split_headers(block)
    body = sent
    if "chunked" in (header(headers, "Transfer-Encoding") or "").lower():
        out, rest = [], body
        while True:
            size, mark, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not mark or not n:
                break
            out.append(rest[:n])
            rest = rest[n + 2:]
        body = b"".join(out)
    if (header(headers, "Content-Encoding") or "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47).decompress(body)
        except zlib.error:
            pass
    return status.decode("latin-1"), headers, sent, body


def plain_text(kind: str, body: bytes) -> tuple[str, str]:
    """Character set and text of a payload: of HTML the visible text, a line for each block."""
    found = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:2048])
    charset = found.group(1).decode() if found else "utf-8"
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        charset = "utf-8"
        text = body.decode(charset, "replace")
    if "html" in kind.lower():
        text = html.unescape(_TAG.sub("\n", _INLINE.sub("", _HIDDEN.sub("", text))))
    return charset, "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def sha256(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def derive_one(record: bytes | None) -> list[dict]:
    """The derived records of one record: two of a response, none of another type, and one
    row without a record for a malformed one."""
    try:
        if not record:
            raise Malformed("empty")
        source, block = parse(record)
        ident = header(source, "WARC-Record-ID")
        if not ident:
            raise Malformed("no record id")
        if (header(source, "WARC-Type") or "").lower() != "response":
            return []
        status, http, sent, body = payload_of(block)
    except Malformed as error:
        return [{"error": str(error)}]
    kind = header(http, "Content-Type") or "application/octet-stream"
    charset, text = plain_text(kind, body) if re.match(r"text/|application/(xhtml|xml|json)", kind, re.I) else ("", "")
    checks = {"block": digest_ok(header(source, "WARC-Block-Digest"), block), "payload": digest_ok(header(source, "WARC-Payload-Digest"), sent)}
    payload_digest = header(source, "WARC-Payload-Digest") or sha256(sent)
    fields = [("status", status), *((f"warc-{k}", v) for k, v in source), *((f"http-{k}", v) for k, v in http), ("charset", charset),
              ("block-digest-ok", checks["block"]), ("payload-digest-ok", checks["payload"]), ("payload-length", len(sent)), ("decoded-length", len(body))]
    metadata = "".join(f"{k}: {'unknown' if v is None else str(v).lower() if isinstance(v, bool) else v}\r\n" for k, v in fields).encode()
    out = []
    for what, content, data in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text.encode())):
        new = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{what} {ident}')}>"
        digest = sha256(data)
        headers = [("WARC-Type", what), ("WARC-Record-ID", new), ("WARC-Refers-To", ident),
                   *((k, v) for k in KEPT if (v := header(source, k)) is not None),
                   ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", payload_digest if what == "metadata" else digest), ("Content-Type", content)]
        out.append({"warc_type": what, "record_id": new, "refers_to": ident, "target_uri": header(source, "WARC-Target-URI"),
                    "date": header(source, "WARC-Date"), "block_digest": digest, "source_payload_digest": payload_digest,
                    "block_digest_ok": checks["block"], "payload_digest_ok": checks["payload"], "n_bytes": len(data), "record": build(headers, data)})
    return out


_KINDS = {"warc_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "date": pa.string(),
          "block_digest": pa.string(), "source_payload_digest": pa.string(), "block_digest_ok": pa.bool_(), "payload_digest_ok": pa.bool_(),
          "n_bytes": pa.int64(), "record": pa.binary(), "error": pa.string()}
_DDL = ("warc_type string, record_id string, refers_to string, target_uri string, date string, block_digest string, "
        "source_payload_digest string, block_digest_ok boolean, payload_digest_ok boolean, n_bytes long, record binary, error string")


def derive(records: DataFrame, key: str) -> DataFrame:
    """Metadata and conversion records of every response in ``records``.

    ``records`` needs ``record`` (bytes of one WARC record) and the ``key`` column, which is
    carried on; other columns are ignored.  Returns key, warc_type, record_id, refers_to,
    target_uri, date, block_digest, source_payload_digest, block_digest_ok, payload_digest_ok
    (whether the source's digests hold; null where it has none), n_bytes, record, error.
    Responses give two rows; other record types none; a malformed or null record one row with
    its error and no record.  Repeated rows give equal rows, with equal identifiers; an
    empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            rows = [(i, row) for i, record in enumerate(batch.column(1).to_pylist()) for row in derive_one(record)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                                              *[pa.array([r.get(c) for _, r in rows], k) for c, k in _KINDS.items()]], names=["key", *_KINDS])
    return records.select(F.col(key).alias("key"), "record") \
        .mapInArrow(run, f"key {records.schema[key].dataType.simpleString()}, {_DDL}").withColumnRenamed("key", key)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as WARC response records (page_id, record): input for ``derive``."""
    def labelled(data: Column) -> Column:
        return F.concat(F.lit("sha256:"), F.sha2(data, 256))
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    block = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8"), body)
    ident = F.md5(F.encode(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url")), "UTF-8"))
    ident = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(ident, a, n), F.lit("-" if a < 21 else ">"))])
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), ident, F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Block-Digest: "), labelled(F.col("block")), F.lit("\r\nWARC-Payload-Digest: "), labelled(F.col("body")),
                    F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", "url", body.alias("body"), block.alias("block")) \
        .select("page_id", F.concat(F.encode(head, "UTF-8"), F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))
