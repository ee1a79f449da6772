"""Thresholds and folder names, passed to operators as values."""

from __future__ import annotations

from dataclasses import dataclass

ENVIRONMENTS = ("sandbox", "production")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    """The defaults of the intake rules."""

    auto_confidence: float = 85.0
    review_confidence: float = 70.0
    prompt_confidence: float = 75.0
    field_confidence: float = 60.0
    stale_days: int = 180
    poll_seconds: int = 120
    calls_per_minute: int = 450
    calls_in_flight: int = 8
    model_attempts: int = 2
    model_delay: float = 2.0
    model_multiplier: float = 2.0
    api_attempts: int = 3
    api_delay: float = 1.0
    inbox: str = "INBOX"
    processed_folder: str = "Processed"
    failed_folder: str = "Failed"
    review_folder: str = "ManualReview"
    method_ref: str = "1"
    account_ref: str = "2"
    item_ref: str = "3"
    unique_ids: bool = False  # refuse a row whose id is stored already
    environment: str = "sandbox"
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if self.environment not in ENVIRONMENTS:
            raise ValueError(f"environment must be one of {ENVIRONMENTS}")
        object.__setattr__(self, "log_level", self.log_level.upper())
        if self.log_level not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {LOG_LEVELS}")
