"""What Python workers hold between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(step: Step) -> Step:
    """The step for ``mapInArrow``; at its end Arrow's freed memory goes back to the system.

    Workers are used again by later stages and tables, so what one stage leaves would count in all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return run
