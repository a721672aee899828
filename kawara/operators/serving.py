"""Filters, orders, facets and cards over serving rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank
from ..functions.words import GENRE_COLOURS, OTHER_COLOUR, PREFS

ORDERS = ("date-desc", "date-asc", "open-desc", "open-asc", "genre", "pref")


@dataclass(frozen=True)
class Filters:
    """What a reader asked for; empty means anything."""

    pref: str = ""
    city: str = ""
    within_days: int | None = None
    genre: str = ""
    source_type: str = ""
    source_name: str = ""
    require_tel: bool = False
    require_addr: bool = False
    show_hidden: bool = False
    pinned_pref: str | None = None
    order: str = "date-desc"

    @property
    def effective_pref(self) -> str:
        return self.pref if self.pinned_pref is None else self.pinned_pref

    def choose_pref(self, pref: str) -> Filters:
        """Another prefecture, which clears the city."""
        return replace(self, pref=pref, city="")

    def reset(self) -> Filters:
        """Defaults, but for the pinned prefecture (and what was chosen there) and the hidden rows' switch."""
        return Filters(pref=self.pref if self.pinned_pref is not None else "", pinned_pref=self.pinned_pref, show_hidden=self.show_hidden)

    def __post_init__(self):
        if self.order not in ORDERS:
            raise ValueError(f"order is one of {', '.join(ORDERS)}")


def any_source(column: str, value: str) -> Column:
    """Whether one of a row's sources has the value."""
    return F.exists("sources", lambda s: s[column] == value)


def predicate(f: Filters, today: Column, date: str = "date") -> Column:
    """All that ``f`` asks of a row but hiding, as one condition. Dates in the future count as recent."""
    tests = [F.lit(True)]
    tests += [F.col("pref") == f.effective_pref] * bool(f.effective_pref)
    tests += [F.col("city") == f.city] * bool(f.city)
    if f.within_days is not None:
        tests.append(F.col(date) >= F.date_sub(today, f.within_days))
    tests += [F.col("genre") == f.genre] * bool(f.genre)
    tests += [any_source("type", f.source_type)] * bool(f.source_type)
    tests += [any_source("name", f.source_name)] * bool(f.source_name)
    tests += [F.col("tel") != ""] * f.require_tel
    tests += [F.col("addr") != ""] * f.require_addr
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def hidden_ids(state: DataFrame, column: str = "hidden") -> DataFrame:
    """Ids of a stored JSON array, one a row; what isn't such an array hides nothing."""
    return state.select(F.explode(F.from_json(column, "array<string>")).alias("id")).where("id IS NOT NULL").distinct()


def apply_filters(rows: DataFrame, f: Filters, today: Column, hidden: DataFrame | None = None) -> DataFrame:
    """Serving rows that ``f`` lets pass; rows whose id is in ``hidden`` (id) go unless shown. Rows without id are never hidden."""
    out = rows.where(predicate(f, today))
    return out if f.show_hidden or hidden is None else out.join(hidden.select("id"), "id", "left_anti")


def hidden_count(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(hidden.select("id"), "id", "left_semi").agg(F.count("*").alias("n"))


def order_keys(order: str) -> list[Column]:
    """Keys of an order of serving rows. Ties fall back on the newest listing, then the id."""
    newest = F.col("date").desc()
    opened = nonblank(F.col("open_date"))
    own = {
        "date-desc": [newest],
        "date-asc": [F.col("date").asc()],
        "open-desc": [opened.desc_nulls_last()],
        "open-asc": [opened.asc_nulls_last()],
        "genre": [F.collate("genre", "ja").asc(), newest],
        "pref": [F.array_position(F.array(*[F.lit(p) for p in PREFS]), F.col("pref")).asc(), newest],
    }[order]
    return [*own, newest, F.col("id").cast("long").asc()]


def apply_order(rows: DataFrame, order: str) -> DataFrame:
    return rows.orderBy(*order_keys(order))


def month_day(date: Column) -> Column:
    """MM/DD of an ISO date."""
    return F.replace(F.substring(date, 6, 5), F.lit("-"), F.lit("/"))


def countdown(open_date: Column, today: Column) -> Column:
    """struct<text, future>: how far off an opening is; null without a date. The wording is fixed."""
    days, day = F.datediff(F.to_date(open_date), today), month_day(open_date)
    label = (
        F.when(days > 0, F.concat(F.lit("🎉 "), day, F.lit(" オープン予定（あと"), days.cast("string"), F.lit("日）")))
        .when(days == 0, F.concat(F.lit("🎉 本日 "), day, F.lit(" オープン！")))
        .when(days >= -7, F.concat(F.lit("🎉 "), day, F.lit(" オープン（"), (-days).cast("string"), F.lit("日前）")))
        .otherwise(F.concat(F.lit("🎉 "), day, F.lit(" オープン")))
    )
    return F.when(nonblank(open_date).isNotNull(), F.struct(label.alias("text"), (days >= 0).alias("future")))


def genre_colour(genre: Column) -> Column:
    colours = F.create_map(*[F.lit(x) for pair in GENRE_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(colours, genre), F.lit(OTHER_COLOUR))


def cards(rows: DataFrame, today: Column) -> DataFrame:
    """What is shown of a row: key, colour, badge, heading, shop, opening, place, station, phone, source, more. The wording is fixed.

    A row without sources has no source and no link.
    """
    title, name, addr, station, tel = (nonblank(F.col(c)) for c in ("article_title", "name", "addr", "nearest_station", "tel"))
    near = F.concat(F.lit("🚃 最寄: "), station)
    first = F.try_element_at("sources", F.lit(1))
    return rows.select(
        F.coalesce(F.col("id"), F.concat_ws("-", "name", "addr")).alias("key"),
        genre_colour(F.col("genre")).alias("colour"),
        "genre",
        F.concat(F.lit("掲載 "), month_day(F.col("date").cast("string"))).alias("badge"),
        F.coalesce(title, F.col("name")).alias("heading"),
        F.when(title.isNotNull() & (title != name), name).alias("shop"),
        countdown(F.col("open_date"), today)["text"].alias("opening"),
        F.coalesce(addr, near, F.lit("住所未抽出")).alias("place"),
        F.when(addr.isNotNull(), near).alias("station"),
        F.coalesce(F.concat(F.lit("📞 "), tel), F.lit("電話番号記載なし")).alias("phone"),
        first["name"].alias("source"),
        first["url"].alias("link"),
        F.when(F.size("sources") > 1, F.format_string("+%d件", F.size("sources") - 1)).alias("more"),
    )
