"""Boards that a page links to, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The addresses of boards, and slugs of the boards' makers.
ADDRESSES = {
    "greenhouse": r"(?:boards|job-boards|boards-api)\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_\-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([a-z0-9_\-]+)",
    "lever": r"jobs\.lever\.co/([a-z0-9_\-]+)",
    "smartrecruiters": r"(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_\-]+)",
    "workable": r"(?:apply|jobs)\.workable\.com/([a-z0-9_\-]+)",
}
WORKDAY = r"https?://([a-z0-9\-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:wday/cxs/[a-z0-9\-]+/)?([a-z0-9_\-]+)"
NOISE = ("embed", "job_board", "static", "assets", "www", "api", "v1", "search", "jobs", "careers", "company", "companies", "about", "privacy", "terms", "greenhouse", "ashby", "lever", "workable", "smartrecruiters")


def board_links(markup: Column | str) -> Column:
    """An array of structs board and slug, each once: board by board, and of one board in page order. Empty for a null.

    A workday slug is tenant:instance:site, of which the site keeps its case.
    """
    page = F.coalesce(F.col(markup) if isinstance(markup, str) else markup, F.lit(""))
    every = lambda pattern, group: F.regexp_extract_all(page, F.lit(f"(?i){pattern}"), F.lit(group))
    named = lambda board, slugs: F.transform(slugs, lambda s: F.struct(F.lit(board).alias("board"), s.alias("slug")))
    lists = []
    for board, pattern in ADDRESSES.items():
        slugs = F.filter(F.transform(every(pattern, 1), F.lower), lambda s: (F.length(s) >= 2) & ~s.isin(*NOISE))
        lists.append(named(board, slugs))
    packed = F.zip_with(F.zip_with(every(WORKDAY, 1), every(WORKDAY, 2), lambda a, b: F.lower(F.concat_ws(":", a, b))), every(WORKDAY, 3), lambda ab, c: F.concat_ws(":", ab, c))
    return F.array_distinct(F.concat(*lists, named("workday", packed)))
