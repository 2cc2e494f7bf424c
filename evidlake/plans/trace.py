"""Times of a pipeline run by stage, and prices of tokens.

Calls and tokens are columns of the answers, by question; only the wall times of the
stages, which run for all questions together, are kept on the driver.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

#: prices in dollars per million tokens are read from these variables
INPUT_PRICE, OUTPUT_PRICE = "EVIDLAKE_INPUT_COST_PER_1M", "EVIDLAKE_OUTPUT_COST_PER_1M"
# The stages with a time in the predictions file.
STAGES = ("total", "retrieval", "generation", "evidence_grading", "query_rewrite", "corrective_retrieval", "calculation_execution")


def prices() -> tuple[float, float] | None:
    """Input and output price; None unless both are set."""
    said = [os.environ.get(name, "").strip() for name in (INPUT_PRICE, OUTPUT_PRICE)]
    return (float(said[0]), float(said[1])) if all(said) else None


@dataclass
class Trace:
    stage_ms: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Adds the wall time of the block to a stage."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stage_ms[name] = self.stage_ms.get(name, 0.0) + (time.perf_counter() - began) * 1000

    def shared(self, questions: int) -> dict[str, float]:
        """The times of one of so many questions."""
        return {name: ms / max(questions, 1) for name, ms in self.stage_ms.items()}
