"""Scans and node derivations over the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.sources import nodes as N
from coursewright.sources.tables import table

QUERIES = {
    "scan_text_nodes": lambda s, sf: N.scan_text_nodes(table(s, sf, "documents")),
    "document_nodes": lambda s, sf: N.document_nodes(s, sf),
    "scan_html_blocks": lambda s, sf: N.scan_html_blocks(table(s, sf, "pages")),
    "scan_document_registry": lambda s, sf: N.scan_document_registry(
        # URLs without their scheme act as registry lines; the paths of even hosts' first pages are tracked.
        table(s, sf, "pages").select(F.regexp_replace("url", "^https?:/", "").alias("value")).unionByName(
            table(s, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("value"))
        ).unionByName(table(s, sf, "documents").select(F.concat(F.lit(" "), "source", F.lit("/x.pdf ")).alias("value"))),
        table(s, sf, "pages").where(F.col("url").contains("?")).select(
            F.regexp_replace("url", "^https?://", "").alias("source")
        ),
    ),
}
