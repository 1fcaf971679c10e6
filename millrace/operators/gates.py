"""Quality gates over documents: confidentiality, extraction status, reports."""

from __future__ import annotations

import io
import re
import zipfile
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship


def confidential(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows with a sign of confidentiality, and the sign."""
    return docs.withColumn("reason", S.confidential_reason(F.col(path), F.col(text))).where(F.col("reason").isNotNull())


def withhold(results: DataFrame, flagged: DataFrame, acknowledged: bool, key: str = "path") -> DataFrame:
    """Without acknowledgement flagged rows go; with it they stay, marked."""
    if not acknowledged:
        return results.join(flagged.select(key).distinct(), key, "left_anti").withColumn("marked", F.lit(False))
    marks = flagged.select(key).distinct().withColumn("__m", F.lit(True))
    return results.join(marks, key, "left").withColumn("marked", F.coalesce("__m", F.lit(False))).drop("__m")


def statuses(docs: DataFrame, text: str = "text", supported=None) -> DataFrame:
    return docs.withColumn("status", S.extraction_status(F.col(text), supported if supported is not None else F.lit(True)))


def report(docs: DataFrame, by: str) -> DataFrame:
    """Counts of each status by domain."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return docs.groupBy(by).agg(*(count(s) for s in ("ok", "thin", "failed", "unsupported")))


# Mail sensitivities that mark a message.
SENSITIVE = ("confidential", "company-confidential", "personal", "private", "restricted")


def metadata_reasons(files: DataFrame) -> DataFrame:
    """``path, reason`` of files (``path, ext, content``) whose metadata marks them: the Sensitivity header of mails,
    title, subject, keywords and category of Office files, keywords and subject of PDF files. Unreadable files give no row."""
    ship(files.sparkSession)

    def properties(ext: str, content: bytes) -> tuple[str, str]:
        if ext == "eml":
            value = (BytesParser().parsebytes(content, headersonly=True).get("Sensitivity") or "").strip().lower()
            return "mail", "confidential" if value in SENSITIVE else ""
        if ext in ("docx", "pptx", "xlsx"):
            return "properties", re.sub(r"<[^>]*>", " ", zipfile.ZipFile(io.BytesIO(content)).read("docProps/core.xml").decode("utf-8", "ignore"))
        if ext == "pdf":
            return "properties", " ".join(m.decode("latin-1") for m in re.findall(rb"/(?:Keywords|Subject)\s*\(([^)]*)\)", content))
        return "", ""

    def run(batches):
        for b in batches:
            found = []
            for path, ext, content in zip(b["path"], b["ext"], b["content"], strict=True):
                try:
                    where, text = properties(ext, bytes(content))
                except (zipfile.BadZipFile, KeyError, ValueError):
                    continue
                if m := re.search(S.CONFIDENTIAL, text):
                    found.append((path, f"{where}: {m[0].lower()}"))
            yield pd.DataFrame(found, columns=["path", "reason"])

    return files.select("path", "ext", "content").mapInPandas(run, "path string, reason string")
