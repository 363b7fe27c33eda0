"""Mail sources: account files, stored mails, attachments.

Mails are read from landed ``.eml`` files with Spark's ``binaryFile`` source, so listing,
splitting and modification-time filters are the file system's; parsing a MIME tree has no
built-in operator and runs in ``mapInPandas``.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from email.header import decode_header, make_header
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIL_SCHEMA = (
    "path string, message_id string, in_reply_to string, references string, sender string, subject string, date string, body string, "
    "attachments array<struct<filename:string,content_type:string,size:long>>, error string"
)
#: Budgets of attachment texts: files of a mail, bytes of a file, characters of a file.
MAX_FILES, MAX_FILE_BYTES, MAX_CHARS = 8, 8 << 20, 24_000


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated account file: lines with ``@`` and at least six columns. Secrets stay in their column."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.contains("value", F.lit("@")) & (F.size(parts) >= 6))
    names = ("site_url", "brand", "mailbox", "secret", "host", "note")
    return rows.select(*(F.trim(parts[i]).alias(n) for i, n in enumerate(names)))


def header(value: str | None) -> str:
    """A decoded header; an undecodable one stays as it is."""
    if not value:
        return ""
    try:
        return str(make_header(decode_header(str(value))))
    except (LookupError, UnicodeError, ValueError):
        return str(value)


def _text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def parse_mail(raw: bytes) -> dict:
    """Headers, the plain text (else the stripped HTML) and attachments; forwarded mails are walked too."""
    msg = email.message_from_bytes(raw, policy=email.policy.compat32)
    plain, html, files = [], [], []
    for part in msg.walk():
        if part.is_multipart():
            continue
        name, kind = part.get_filename(), part.get_content_type()
        if name or part.get_content_disposition() == "attachment":
            files.append({"filename": header(name) or "unnamed", "content_type": kind, "size": len(part.get_payload(decode=True) or b"")})
        elif kind == "text/plain":
            plain.append(_text(part))
        elif kind == "text/html":
            html.append(_text(part))
    body = "\n".join(plain) if any(p.strip() for p in plain) else re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", "\n".join(html)))
    return {
        "message_id": msg.get("Message-ID"), "in_reply_to": msg.get("In-Reply-To"), "references": msg.get("References"), "sender": header(msg.get("From")),
        "subject": header(msg.get("Subject")), "date": msg.get("Date"), "body": body, "attachments": files, "error": None,
    }


def mails(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """S3: mails of a folder; ``since`` prunes files by their time. A mail that can't be parsed is a row with an error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in re.sub(r"<.*>", "", MAIL_SCHEMA).split(", ")]
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append({"path": p, **parse_mail(bytes(raw))})
                except Exception as e:
                    rows.append({"path": p, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names)

    return reader.load(path).select("path", "content").mapInPandas(run, MAIL_SCHEMA)


def _xml_text(data: bytes, tag: str, joint: str) -> str:
    root = ElementTree.fromstring(data)
    return joint.join("".join(t.text or "" for t in node.iter() if t.tag.endswith("}t")) for node in root.iter() if node.tag.endswith(tag))


def file_text(name: str, data: bytes) -> tuple[str, str, str]:
    """(status, reason, text) of an attachment by its extension; what can't be read says why."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if len(data) > MAX_FILE_BYTES:
        return "skipped", "too large", ""
    try:
        if ext in ("txt", "csv", "tsv", "log", "json", "xml", "html", "htm", "md"):
            try:
                text = data.decode("utf-8-sig")
            except UnicodeDecodeError:
                text = data.decode("cp1251", "replace")
            if ext in ("html", "htm"):
                text = re.sub(r"<[^>]*>", " ", text)
        elif ext == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                text = _xml_text(z.read("word/document.xml"), "}p", "\n")
        elif ext == "xlsx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = [_join(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if n.tag.endswith("}si")]
                sheets = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
                text = "\n".join(_sheet(z.read(n), shared) for n in sheets)
        elif ext == "pdf":
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", data)
            if not parts:
                return "skipped", "no plain text in the pdf", ""
            text = "\n".join(re.sub(rb"\\(.)", rb"\1", p).decode("latin-1") for p in parts)
        else:
            return "skipped", f"no reader for {ext or 'files without extension'}", ""
    except Exception as e:
        return "error", f"{type(e).__name__}: {e}", ""
    return "processed", "", text[:MAX_CHARS]


def _join(node) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))


def _sheet(data: bytes, shared: list[str]) -> str:
    lines = []
    for row in (n for n in ElementTree.fromstring(data).iter() if n.tag.endswith("}row")):
        cells = []
        for c in row:
            v = next((x.text for x in c if x.tag.endswith("}v")), None)
            cells.append(shared[int(v)] if v is not None and c.get("t") == "s" and int(v) < len(shared) else v if v is not None else _join(c))
        lines.append("\t".join(cells))
    return "\n".join(lines)


def attachment_texts(spark: SparkSession, path: str) -> DataFrame:
    """Path, status, reason and text of the files of a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *file_text(p.rsplit("/", 1)[-1], bytes(d))) for p, d in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "status", "reason", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, status string, reason string, text string")
