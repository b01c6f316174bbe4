"""Parameters of a scan; plan builders read them, they never become columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanOptions:
    """What counts as a line of dialogue, and how speakers are found."""

    min_len: int = 2
    max_len: int = 400
    require_cjk: bool = True
    strip_tags: bool = True
    keep_narration: bool = True
    drop_ascii_only: bool = True
    aggressive: bool = False
    chinese_only: bool = False
    track_speakers: bool = True
    guess_bare_speakers: bool = False
    narration_speaker: str = ""

    @property
    def tracking(self) -> bool:
        """Guessing bare names implies tracking: a guessed name is of use only if it carries on."""
        return self.track_speakers or self.guess_bare_speakers


@dataclass(frozen=True)
class ScanOptions:
    """Which sources are read and how their versions are resolved."""

    engines: tuple[str, ...] | None = None
    include_generic: bool = False
    auto_generic_if_empty: bool = True
    encoding: str = "auto"
    min_engine_score: int = 1
    max_file_bytes: int = 64 << 20
    max_total_bytes: int = 512 << 20
    generic_max_file_bytes: int = 16 << 20
    generic_max_total_bytes: int = 256 << 20
    dedupe: bool = True
    override_archives: bool = True
    clean: CleanOptions = field(default_factory=CleanOptions)
