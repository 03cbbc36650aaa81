"""Exchanges, scans and joins in the executed plan of registered queries: plan_shape.py sf_dir name ..."""

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from demandgrid.catalog import QUERIES, load_all  # noqa: E402
from demandgrid.session import build_session  # noqa: E402

WORDS = r"(ReusedExchange|BroadcastExchange|Exchange \w+|Scan parquet|SortMergeJoin|BroadcastHashJoin|" \
        r"BroadcastNestedLoopJoin|CartesianProduct|WindowGroupLimit|Window|Expand|MapInPandas|FlatMapGroupsInPandas|Sort)\b"


def main() -> None:
    load_all()
    spark = build_session("plans", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:]:
        df = QUERIES[name](spark, sys.argv[1])
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        text = re.sub(r"== Initial Plan ==.*", "", text, flags=re.S)
        found = collections.Counter(re.findall(r"(?:\+-|:-|:|\)) ?" + WORDS, text))
        print(name, dict(sorted(found.items())), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
