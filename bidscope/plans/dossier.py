"""Everything known about a notice in one row, for reading or for a reviewer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidscope.operators.list_digests import list_digests
from bidscope.operators.similar import SET
from bidscope.operators.skew import top_k
from bidscope.plans.pricing import ReferencePrices, scale_bounds


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """Rows with their place in the key, all or the first ``limit``."""
    if limit is not None:
        return top_k(rows, keys, order, limit, "_rank")
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def notice_items_nested(items: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The items of each notice as an array; with a limit, the first of them."""
    first = _ranked(items, ["notice_id"], [F.col(c) for c in order], limit)
    fields = ["description", "unit", "quantity", "estimate", "code", "award"]
    return first.groupBy("notice_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("items")
    )


def state_boards_nested(boards: DataFrame, limit: int | None = None) -> DataFrame:
    """The market rows of each state as an array (``level`` is the state)."""
    best = _ranked(boards, ["level"], [F.col("weighted_wins").desc(), F.col("platform")], limit)
    return best.groupBy(F.col("level").alias("state")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "platform", "items", "wins", "mean_discount"))).alias("market")
    )


def notice_dossier(
    notices: DataFrame, items: DataFrame, analyses: DataFrame, prices: DataFrame, boards: DataFrame,
    item_order: list[str], max_items: int | None = None, max_boards: int | None = None, max_chars: int | None = None,
) -> DataFrame:
    """Notices with document analysis, reference price, items and their state's market.

    analyses and prices are keyed by notice_id; missing parts are null. Texts and lists are whole
    unless a limit is given.
    """
    analysed = analyses
    if max_chars is not None and "text" in analyses.columns:
        short = F.concat(F.substring("text", 1, max_chars), F.lit("\n[... truncado]"))
        analysed = analyses.withColumn("text", F.when(F.length("text") > max_chars, short).otherwise(F.col("text")))
    fields = lambda df: [c for c in df.columns if c != "notice_id"]
    analysis = analysed.select("notice_id", F.struct(*fields(analysed)).alias("analysis"))
    price = prices.select("notice_id", F.struct(*fields(prices)).alias("reference_price"))
    return (
        notices.join(analysis, "notice_id", "left")
        .join(price, "notice_id", "left")
        .join(notice_items_nested(items, item_order, max_items), "notice_id", "left")
        .join(state_boards_nested(boards, max_boards), "state", "left")
    )


def analyzed_status(notices: DataFrame, analyses: DataFrame) -> DataFrame:
    """Whether each notice's document is analysed, with a message where it is not."""
    marks = analyses.select("notice_id", F.col("risk_level"), F.lit(True).alias("analyzed"))
    joined = notices.select("notice_id", "subject").join(marks, "notice_id", "left")
    return joined.withColumns({
        "analyzed": F.coalesce("analyzed", F.lit(False)),
        "message": F.when(F.col("analyzed").isNull(), "Edital ainda não foi analisado."),
    })


@dataclass
class ReferenceDetail:
    """Reference prices with the lists behind them, each held once for all references that share it.

    refs: ref_id, question, tier, ref_estimate. listed: the rows of the lists of notices, notice_lists: the same as
    question, tier, notices. questions: ref_id, profile. profile_lists: profile, items, platforms.
    """

    prices: DataFrame
    refs: DataFrame
    listed: DataFrame
    notice_lists: DataFrame
    questions: DataFrame
    profile_lists: DataFrame
    max_notices: int | None = None

    def rows(
        self, notices: Callable[[Column], Column] | DataFrame = lambda x: x, items: Callable[[Column], Column] = lambda x: x,
        platforms: Callable[[Column], Column] = lambda x: x,
    ) -> DataFrame:
        """One row per reference, with what the functions make of its whole lists.

        A list of notices is narrowed for each reference; what is made of items and platforms is made once per
        profile. A reference without a list has null, one whose list is narrowed to nothing an empty one. In place of a
        function, ``notices`` may be a table (ref_id, notices) of what was made of the lists otherwise.
        """
        if isinstance(notices, DataFrame):
            listed = notices
        else:
            own = F.filter("notices", lambda x: (x["notice_id"] != F.col("ref_id")) & x["value"].between(F.col("low"), F.col("high")))
            if self.max_notices is not None:
                own = F.slice(own, 1, self.max_notices)
            listed = self._asking().join(self.notice_lists, SET).select("ref_id", notices(own).alias("notices"))
        shared = self.profile_lists.select(
            "profile", items(F.col("items")).alias("items"), platforms(F.col("platforms")).alias("platforms")
        )
        shared = self.questions.join(shared, "profile").drop("profile")
        return (
            self.prices.withColumnRenamed("notice_id", "ref_id")
            .join(listed, "ref_id", "left").join(shared, "ref_id", "left")
        )

    def notice_digests(self) -> DataFrame:
        """(ref_id, notices): the MD5 of each reference's whole list of notices, as their texts with a space between them.

        The same as a digest made in ``rows``, but no list is copied for a reference. Needs ``notice_text``.
        """
        order = [-F.col("similarity"), F.col("notice_id"), F.col("value"), F.col("price_source")]
        return list_digests(self.listed, self._asking(), SET, "ref_id", "notice_id", order, "notices", self.max_notices)

    def _asking(self) -> DataFrame:
        """The references with the least and largest value that they admit, made once for a whole list."""
        low, high = scale_bounds("ref_estimate")
        return self.refs.withColumns({"low": low, "high": high})


def reference_price_detail(
    found: ReferencePrices, max_notices: int | None = None, max_items: int | None = None, notice_text: Column | None = None,
) -> ReferenceDetail:
    """Reference prices with their similar notices, similar items (best first), and platforms.

    ``notice_text``, of the columns of the similar notices, is a further field ``text`` of theirs, made once per set.
    A list is one value of a row, in one task's memory.
    """
    more = [] if notice_text is None else [notice_text.alias("text")]
    best = lambda key, *fields: F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_rank"), key, *fields)))
    listed = found.alike.members.select(*SET, "notice_id", "value", "price_source", "similarity", *more)
    text = [] if notice_text is None else ["text"]
    notice_lists = listed.groupBy(*SET).agg(best("notice_id", "value", "price_source", "similarity", *text).alias("notices"))
    items = found.profile_items
    if max_items is not None:
        items = top_k(items, ["profile"], [F.col("similarity").desc(), F.col("item_id")], max_items)
    items = items.groupBy("profile").agg(best("item_id", "value", "price_source", "similarity").alias("items"))
    sold = found.profile_platforms.groupBy("profile").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("items")).alias("order"), "platform", "mean_unit", "items"))).alias("platforms")
    )
    return ReferenceDetail(
        found.prices, found.alike.refs, listed, notice_lists, found.questions, items.join(sold, "profile", "full"), max_notices
    )


def market_detail(
    boards: DataFrame, groups: DataFrame, state: str | None = None, max_boards: int | None = None, max_groups: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Platform rows and groups, optionally of one state; with limits, the first and best of them."""
    if state is not None:
        boards, groups = boards.filter(F.col("level") == state), groups.filter(F.col("level") == state)
    if max_boards is not None:
        boards = boards.orderBy("level", F.col("weighted_wins").desc(), "platform").limit(max_boards)
    if max_groups is not None:
        groups = groups.orderBy(F.col("score").desc(), "level", "key").limit(max_groups)
    return boards, groups
