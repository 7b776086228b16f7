"""Settings from the environment, and logging."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Where tapes are, and how much is logged. Unknown variables are ignored."""

    data_dir: str = "data"
    log_level: str = "INFO"

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None) -> Settings:
        """DATA_DIR and LOG_LEVEL, in any case."""
        given = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        return cls(**{k: given[k] for k in ("data_dir", "log_level") if given.get(k)})


def configure_logging(settings: Settings) -> logging.Logger:
    """One handler of the package's logger, with time, level and name."""
    log = logging.getLogger("flowspark")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(settings.log_level.upper())
    return log
