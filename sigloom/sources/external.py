"""Rows from an external program, run once per input pair inside the tasks."""

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

HIT_SCHEMA = "query string, target string, pident double, length double"


def tabular_hits(pairs: DataFrame, command, attempts=3, identity_field=2, length_field=3) -> DataFrame:
    """Run ``command`` for every row ``query, target`` and parse its tab-separated hits.

    ``command`` is a list in which ``{query}`` and ``{target}`` stand for the two paths.  A failed start is retried.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query, target in zip(frame["query"], frame["target"]):
                argv = [part.format(query=query, target=target) for part in command]
                for attempt in range(attempts):
                    done = subprocess.run(argv, capture_output=True, text=True)
                    if done.returncode == 0:
                        break
                    if attempt == attempts - 1:
                        raise RuntimeError(f"{argv[0]} failed: {done.stderr[:500]}")
                hits = [line.split("\t") for line in done.stdout.splitlines() if line.strip()]
                yield pd.DataFrame({"query": [query] * len(hits), "target": [target] * len(hits),
                                    "pident": [float(h[identity_field]) for h in hits], "length": [float(h[length_field]) for h in hits]})
    return pairs.select("query", "target").mapInPandas(run, HIT_SCHEMA)
