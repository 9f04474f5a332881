"""Running an external engine for each grid: text on standard input, its output and exit code as rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame

RESULT = "grid_id string, code int, output string, error string"


def run(grids: DataFrame, command: list[str], timeout: float = 600.0) -> DataFrame:
    """RESULT of the command (a list, no shell) for each row grid_id, text; one process a row, `timeout` seconds each."""

    def call(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, text in zip(batch.column("grid_id").to_pylist(), batch.column("text").to_pylist()):
                try:
                    done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=False)
                    rows.append((name, done.returncode, done.stdout, done.stderr or None))
                except (OSError, subprocess.TimeoutExpired) as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], [c.split()[0] for c in RESULT.split(", ")])

    return grids.select("grid_id", "text").mapInArrow(call, RESULT)


def answers(beta: str, width: bool = True, batch: bool = True, low: int = -4, high: int = 3, runs: int = 100, threads: int = 1) -> str:
    """The engine's questions answered in order: exponent, width functions, batch, its range, runs and threads."""
    yes = lambda v: "y" if v else "n"
    lines = [beta, yes(width)]
    if width:
        lines.append(yes(batch))
        if batch:
            lines += [str(low), str(high), str(runs), str(threads)]
    return "\n".join(lines) + "\n"
