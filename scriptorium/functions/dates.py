"""Date functions: Column -> Column of dates; what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The first ten characters if they are a valid yyyy-MM-dd."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")


def mail_date(c: Column) -> Column:
    """Date of an RFC 2822 time, in UTC."""
    return F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")).cast("date")


def zulu_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("date")


def any_date(c: Column) -> Column:
    """yyyyMMdd, yyyy-MM-dd or yyyy.MM.dd."""
    c = F.trim(c)
    shapes = (("^[0-9]{8}$", "yyyyMMdd"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}$", "yyyy.MM.dd"))
    return F.coalesce(*[F.try_to_date(F.when(c.rlike(shape), c), form) for shape, form in shapes])


def month_date(year: Column, month: Column, otherwise: Column | None = None) -> Column:
    """First day of a month; a month out of range counts as January, a missing year gives `otherwise`."""
    y = F.expr("NULL") if year is None else year.try_cast("int")
    m = F.coalesce(month.try_cast("int"), F.lit(1))
    made = F.try_to_date(F.format_string("%04d-%02d-01", y, F.when(m.between(1, 12), m).otherwise(1)), "yyyy-MM-dd")
    return F.coalesce(F.when(y.between(1, 9999), made), otherwise if otherwise is not None else F.lit(None).cast("date"))


def id_month(c: Column) -> Column:
    """First of the month that a preprint id such as 2403.01234 names."""
    part = F.regexp_extract(c, "(?:^|[^0-9])([0-9]{4})\\.[0-9]{4,5}", 1)
    month = F.substring(part, 3, 2)
    return F.when(month.between("01", "12"), F.try_to_date(F.concat(F.lit("20"), F.substring(part, 1, 2), F.lit("-"), month, F.lit("-01")), "yyyy-MM-dd"))


def year_or_date(c: Column) -> Column:
    """A date, else the first day of a lone year."""
    return F.coalesce(iso_date(c), F.try_to_date(F.when(c.rlike("^[0-9]{4}$"), F.concat(c, F.lit("-01-01"))), "yyyy-MM-dd"))


def path_date(c: Column) -> Column:
    """Date in a URL path /yyyy/MM/dd/ within 1990 to 2099."""
    parts = [F.regexp_extract(c, "/((?:19[9]|20[0-9])[0-9])/([0-9]{1,2})/([0-9]{1,2})(?:/|$)", i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")


# Attributes of meta elements that carry the publication date, best first; keys of linked data; parts of other names that speak of a date.
META = (
    ("property", "article:published_time"),
    ("property", "og:article:published_time"),
    ("name", "article:published_time"),
    ("name", "publish-date"),
    ("name", "publishdate"),
    ("name", "sailthru.date"),
    ("name", "date"),
    ("name", "pubdate"),
    ("itemprop", "datePublished"),
)
LINKED = ("datePublished", "dateCreated", "uploadDate")
LOOSE = "date|time|publish"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, f"(?is)\\b{name}\\s*=\\s*[\"']([^\"']*)[\"']", 1)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda d: d.isNotNull()), F.lit(0))


def page_date(html: Column) -> Column:
    """Publication date of a page, null if nothing can be read.

    The first that is a date of: the known meta elements in order (of each the first such element), the first time element, linked data (scripts
    of type ld+json in order: the object, the objects of its @graph, or those of a list, each by the keys in order), then any meta
    element whose name speaks of a date. The order of attributes does not matter.
    """
    metas = F.regexp_extract_all(html, F.lit("(?is)(<meta\\b[^>]*>)"), F.lit(1))
    having = lambda a, v: F.get(F.filter(metas, lambda m: _attribute(m, a) == v), F.lit(0))
    known = [iso_date(_attribute(having(a, v), "content")) for a, v in META]
    time = iso_date(_attribute(F.regexp_extract(html, "(?is)(<time\\b[^>]*\\bdatetime\\b[^>]*>)", 1), "datetime"))
    scripts = F.regexp_extract_all(html, F.lit("(?is)<script\\b[^>]*\\btype\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script"), F.lit(1))
    one, many, none = "map<string,string>", "array<map<string,string>>", F.array().cast("array<map<string,string>>")
    objects = F.flatten(F.transform(scripts, lambda s: F.concat(F.coalesce(F.array(F.from_json(s, one)), none), F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), many), none), F.coalesce(F.from_json(s, many), none))))
    linked = _first(F.flatten(F.transform(objects, lambda o: F.array(*[iso_date(o[k]) for k in LINKED]))))
    named = lambda m: F.lower(F.coalesce(*[F.nullif(_attribute(m, a), F.lit("")) for a in ("property", "name", "itemprop")], F.lit("")))
    loose = _first(F.transform(F.filter(metas, lambda m: named(m).rlike(LOOSE)), lambda m: iso_date(_attribute(m, "content"))))
    return F.coalesce(*known, time, linked, loose)


def iso_or_null(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
