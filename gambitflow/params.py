"""Parameters of the tools, one dataclass each; the defaults are part of the semantics and
paths are always given by the caller."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Structural:
    puzzle_path: str
    pgn_path: str
    output_root: str
    n_sample: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Motifs:
    puzzle_path: str
    output_root: str
    n_sample: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Tactics:
    puzzle_path: str
    all_themes_path: str
    output_root: str
    n_sample_rating: int = 100
    n_sample_theme: int = 25
    min_popularity: int = 90
    max_pv_length: int = 4
    max_rating_deviation: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Judgement:
    data_path: str
    output_root: str
    max_evaluations: int = 10_000  # 0 or less: all
    tasks_per_category: int = 100
    seed: int = 42


@dataclass(frozen=True)
class CommentFilter:
    pgn: str
    output: str
    max_games: int | None = None
    keywords: str | None = None
    min_words: int = 5


@dataclass(frozen=True)
class CommentCleaner:
    source: str
    output: str
    max_records: int = 0  # all
    batch_size: int = 1024
    max_tokens: int = 128


@dataclass(frozen=True)
class CommentJudge:
    source: str
    output: str
    max_records: int = 0
    batch_size: int = 1024
    max_tokens: int = 8
    heuristics: bool = True


@dataclass(frozen=True)
class Choices:
    source: str
    output_root: str
    n_sample_mcq: int = 100
    sample_size: int = 0  # all
    opening_threshold: int = 12
    middlegame_threshold: int = 30
    embed_batch: int = 256
    embed_max_batch: int = 64
    num_options: int = 4
    num_distractors: int = 3
    seed: int = 42


@dataclass(frozen=True)
class Evaluation:
    dataset_root: str
    output_root: str
    max_tasks: int | None = None
    n_samples_per_task: int | None = None
    add_context: bool = False
    rps: float = 2.0
    burst: int = 4
    save_interval: int = 10
    max_retries: int = 4
    timeout: int = 6000
    max_tokens: int = 8192
    format_example_group: int = 1
    resume: bool = True
    retry_capped: bool = False
    warehouse: str | None = None
    enable_thinking: bool = False
    eval_only: bool = False
