"""Google Play batches: arrays of flat structs, flattened to review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlume.functions import (
    initials_google_play,
    is_star,
    strip_text,
    utc_date,
    whole_score,
)
from revlume.functions.dates import as_instant
from revlume.functions.naming import GOOGLE_PLAY


def parse_google_play(batches: DataFrame) -> DataFrame:
    """Valid reviews of landed Google Play batches.

    A review counts when it has a time, a score of 1..5 after truncation, and
    a text that is not blank.  Narrow: nothing is shuffled.
    """
    keys = [c for c in batches.columns if c not in ("batch", "next_token")]
    r = batches.select(*keys, F.posexplode("batch").alias("entry_pos", "r"))
    types = dict(r.select("r.*").dtypes)
    at = as_instant(F.col("r.at"), types["at"])
    replied_at = as_instant(F.col("r.repliedAt"), types["repliedAt"])
    rows = r.select(
        *keys,
        "entry_pos",
        at.alias("review_ts"),
        utc_date(at).alias("review_date"),
        whole_score(F.col("r.score")).alias("star_rating"),
        initials_google_play(F.col("r.userName")).alias("reviewer_anonymized"),
        strip_text(F.col("r.content")).alias("review_text"),
        F.lit(GOOGLE_PLAY).alias("platform"),
        F.coalesce("r.thumbsUpCount", F.lit(0)).alias("thumbs_up_count"),
        F.nullif(strip_text(F.col("r.replyContent")), F.lit("")).alias("developer_reply"),
        utc_date(replied_at).alias("developer_reply_date"),
    )
    return rows.where(
        F.col("review_ts").isNotNull()
        & is_star(F.col("star_rating"))
        & (F.col("review_text") != "")
    )
