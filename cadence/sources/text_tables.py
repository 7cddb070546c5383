"""Fixed-width tables to text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.ordering import columns
from cadence.operators.tables import IS_HEADER, LINE, format_table


def sink_text_table(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists",
                    **table) -> None:
    """Write ``df`` as a text table, header first, rows in ``order``.

    ``table`` goes to ``format_table``.  The files read in name order give the table.
    """
    names = table.pop("names", None) or df.columns
    keys = {f"__order{i}": n for i, n in enumerate(order)}
    keyed = df.withColumns({k: columns(n)[0] for k, n in keys.items()})
    lines = format_table(keyed, names=names, keep=list(keys), **table)
    lines.orderBy(F.col(IS_HEADER).desc(), *keys).select(LINE).write.mode(mode).text(path)
