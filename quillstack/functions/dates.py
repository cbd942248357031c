"""Date functions: several formats, never an error, never a default from today's date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond ISO 8601, the forms that pages show.
FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss Z", "MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a")


def lenient_timestamp(text: Column) -> Column:
    """Timestamp of a date string; null for what no format fits."""
    clean = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *(?=[0-9])", "")  # a weekday says nothing more
    return F.coalesce(F.try_to_timestamp(clean), *[F.try_to_timestamp(clean, F.lit(f)) for f in FORMATS])


def iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def checked_date(text: Column, field: str) -> tuple[Column, Column]:
    """(ISO string or null, issue or null): blank is missing, unreadable is an issue."""
    given = F.coalesce(F.trim(text), F.lit("")) != ""
    stamp = lenient_timestamp(text)
    return F.when(given, iso(stamp)), F.when(given & stamp.isNull(), F.concat(F.lit(f"Invalid date format in {field}: "), text))


def effective_dates(url_date: Column, meta_published: Column, meta_modified: Column, ld_published: Column, ld_modified: Column, dom_date: Column) -> tuple[Column, Column]:
    """(published, modified) as ISO strings: structured data before meta tags before the URL before the page's own text."""
    published = F.coalesce(lenient_timestamp(ld_published), lenient_timestamp(meta_published), url_date, lenient_timestamp(dom_date))
    return iso(published), iso(F.coalesce(lenient_timestamp(ld_modified), lenient_timestamp(meta_modified)))


def ld_article(script: Column) -> Column:
    """The script if it is structured data of a post."""
    return F.when(F.get_json_object(script, "$.@type").isin("BlogPosting", "Article"), script)
