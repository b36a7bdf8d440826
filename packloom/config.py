"""Settings of an export and of trace folding."""
from __future__ import annotations

from dataclasses import dataclass, field

from packloom import constants as K


@dataclass(frozen=True)
class ExportConfig:
    file_limit: int | None = 200  # None: all files
    max_file_size_kb: int = 500
    ignored_names: tuple[str, ...] = tuple(K.IGNORED_NAMES)
    filename_filters: tuple[str, ...] = ()
    filters_enabled: bool = False
    path_header: bool = True
    directory_tree: bool = False
    files_in_tree: bool = False
    repo_summary: bool = False
    generated_at: str | None = None  # timestamp in the summary; without it, the time of the run
    line_numbers: bool = True
    output_format: str = "plain"  # plain | markdown | xml
    dependent_cap: int = K.DEPENDENT_CAP
    dependent_max_bytes: int = K.DEPENDENT_MAX_BYTES
    dependent_expand_limit: int = K.DEPENDENT_EXPAND_LIMIT
    # (reason, callable(files DataFrame) -> boolean Column[, position in the chain])
    extra_filters: tuple = field(default=())


@dataclass(frozen=True)
class FoldConfig:
    """Defaults of the user-level action; ``PLAIN_FOLD`` holds those of the bare folder."""

    min_frames: int = 3
    keep_head: int = 1
    keep_tail: int = 1
    package_hints: bool = True
    fold_ellipsis: bool = False
    preserve_indent: bool = True
    append_raw: bool = True
    always_fold: tuple[str, ...] = tuple(K.ALWAYS_FOLD_PREFIXES)
    never_fold: tuple[str, ...] = tuple(K.NEVER_FOLD_PREFIXES)


PLAIN_FOLD = FoldConfig(
    keep_head=0, keep_tail=0, package_hints=False, fold_ellipsis=True,
    preserve_indent=False, append_raw=False,
)
