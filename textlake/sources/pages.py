"""Text of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def stripped(html: Column) -> Column:
    """Without scripts, styles, comments and tags; entities resolved; blanks collapsed."""
    out = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, stripped(F.col(html)).alias("text"))
