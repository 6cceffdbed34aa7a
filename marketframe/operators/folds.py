"""Order-dependent folds in constant memory.

Some ledgers are sequential by nature (a sell is refused when the position is too small, a
signal only gets the cash the earlier ones left). The rows are shuffled by key, sorted inside
the partitions by Spark (which spills), and streamed through a small Python state machine in
Arrow batches. A group is never materialised, so its size is not limited by memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[[dict, dict], dict]


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], dict],
    step: Step,
    added: str,
    reads: Sequence[str] | None = None,
) -> DataFrame:
    """Apply ``step(state, row) -> new columns`` to the rows of each key in order.

    ``start`` builds the state of a key; ``added`` is the DDL of the columns that ``step``
    returns, appended to the input columns. ``row`` has the columns in ``reads``, or all.
    """
    keys = list(keys)
    new_fields = T.StructType.fromDDL(added) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(added)
    schema = T.StructType(df.schema.fields + new_fields.fields)
    names = [f.name for f in new_fields.fields]
    used = list(reads) if reads else df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            results = []
            of_key = zip(*(pdf[k].tolist() for k in keys))
            for key, values in zip(of_key, zip(*(pdf[c].tolist() for c in used))):
                if key != current:
                    current, state = key, start()
                results.append(step(state, dict(zip(used, values))))
            yield pdf.assign(**{n: [r[n] for r in results] for n in names})

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)
