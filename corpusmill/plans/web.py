"""URL lists joined with a page table: page records per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.pages import page_records
from ..sinks.writers import write_by_group


def page_records_for_lists(url_lists: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of the pages each list asks for, as (list_name, page record). A URL counts once per list. The raw pages
    are reduced to the wanted ones before anything is parsed; lists that are small by their true size are broadcast."""
    wanted = url_lists.select("list_name", "url").distinct()
    found = pages.join(wanted.select("url").distinct(), "url", "left_semi")
    return page_records(found).join(wanted, "url")


def write_page_records(records: DataFrame, root: str) -> None:
    write_by_group(records, root, "list_name")
