"""Parameters shared by the feature, clustering and detection operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorParams:
    """One immutable parameter set; operators take it as their last argument."""

    w1: int = 1000              # samples per feature window
    w2: int = 100               # detection window: restarts after w2 + 1 quiet features
    partition: int = 2020       # features per chunk; a multiple of w2 + 1
    max_latency: int = 20       # out-of-order bound, in feature windows
    use_log: bool = True
    eps: float = 0.03           # neighbour radius in (f1, f2)
    temp_eps: float = 0.8       # clusters need temporal locality >= 1 - temp_eps
    loss_thresh: int = 40
    feature_block: int = 4096   # feature windows numbered in one task
    carry_block: int = 128      # feature windows gap-filled in one task
    fan: int = 1024             # chunk transfer maps composed per task

    def __post_init__(self) -> None:
        if self.partition < self.w2:
            raise ValueError("partition must hold at least w2 features")
        if self.loss_thresh < 0:
            raise ValueError("loss_thresh must not be negative")

    @property
    def min_locality(self) -> float:
        # The subtraction stays in floating point: 1.0 - 0.8 is just below 0.2.
        return 1.0 - self.temp_eps
