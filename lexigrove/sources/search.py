"""Paged remote search and detail calls: one partition for each domain.

The client is injected (any callable from parameters to a page of results), so the
source works with whatever service is at hand, and in tests without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds before a call, tries, and the factor between waits.
DELAY, TRIES, BACKOFF = 1.2, 3, 2.0

# The domains and their search strings.
DOMAINS = {
    "ai_machine_learning": "artificial intelligence machine learning deep learning",
    "biotechnology": "CRISPR gene therapy mRNA biotechnology",
    "semiconductor": "semiconductor chip design advanced node fabrication",
    "telecommunications_5g": "5G millimeter wave MIMO network slicing",
    "renewable_energy": "solar panel wind turbine energy storage battery",
}
RESULT = "domain string, patent_id string, publication_number string, title string, language string, is_scholar boolean"
DETAIL = "patent_id string, publication_number string, title string, abstract string, claims array<string>, description string, found boolean"
PAGE_ROWS = 10
# The services asked for results and for one record's details.
SEARCH_ENGINE, DETAIL_ENGINE = "google_patents", "google_patents_details"


def fetch(client: Callable[[dict], dict], params: dict, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """One call with retries; None when all have failed."""
    for k in range(TRIES):
        sleep(DELAY)
        try:
            return client(params)
        except Exception:  # any failure of the service is worth another try
            sleep(DELAY * BACKOFF ** (k + 1))
    return None


def search(spark: SparkSession, client: Callable[[dict], dict], domains: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep, per_domain: int = PAGE_ROWS, language: str = "en") -> DataFrame:
    """The results of each domain, page after page up to ``per_domain`` kept ones.

    Scholar entries, results without a patent_id and those of another language are
    left out (a missing language counts as ``language``); an empty page ends a domain.
    """
    table = spark.createDataFrame(list((domains or DOMAINS).items()), "domain string, query string")
    n = max(1, len(domains or DOMAINS))

    def kept(r: dict) -> bool:
        return not r.get("is_scholar") and bool(r.get("patent_id")) and (r.get("language") or language).lower() == language

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in RESULT.split(", ")]
        for pdf in batches:
            for domain, query in zip(pdf["domain"], pdf["query"]):
                rows, page = [], 1
                while len(rows) < per_domain:
                    got = fetch(client, {"engine": SEARCH_ENGINE, "q": query, "num": PAGE_ROWS, "page": page}, sleep) or {}
                    found = got.get("organic_results") or got.get("results") or []
                    rows += [(domain, r["patent_id"], r.get("publication_number", ""), r.get("title", ""), r.get("language"), False) for r in found if kept(r)]
                    if len(found) < PAGE_ROWS:
                        break
                    page += 1
                yield pd.DataFrame(rows[:per_domain], columns=names)

    return table.repartition(n, F.col("domain")).mapInPandas(run, RESULT)


def details(found: DataFrame, client: Callable[[dict], dict], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One call for each distinct patent_id; a failed one gives a row of nulls with found = false.

    Joined to the results with tables.assemble, a failed call keeps what the search told.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in DETAIL.split(", ")]
        for pdf in batches:
            rows = []
            for patent_id, number in zip(pdf["patent_id"], pdf["publication_number"]):
                got = fetch(client, {"engine": DETAIL_ENGINE, "patent_id": patent_id}, sleep)
                one = got or {}
                claims = [c if isinstance(c, str) else str(c) for c in one.get("claims") or []] if got is not None else None
                rows.append((patent_id, number, one.get("title"), one.get("abstract"), claims, one.get("description"), got is not None))
            yield pd.DataFrame(rows, columns=names)

    return found.select("patent_id", "publication_number").dropDuplicates(["patent_id"]).mapInPandas(run, DETAIL)


def dry_run(pending: DataFrame, done: DataFrame | None = None, key: str = "patent_id") -> dict[str, int]:
    """How many rows a run would take on, and how many are done already; nothing is fetched or written."""
    total = pending.select(key).distinct()
    left = total if done is None else total.join(done.select(key), key, "left_anti")
    n, todo = total.count(), left.count()
    return {"total": n, "done": n - todo, "pending": todo}
