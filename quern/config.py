"""Thresholds of the analysis. Every operator takes them from here, so a run is described by one value."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # The limits that results depend on.
    huge_commit_lines: int = 10_000
    min_file_lines: int = 10
    max_commit_lines: int = 5_000
    max_diff_chars: int = 10_000
    min_diff_lines: int = 20
    reformat_chars: int = 50
    min_snippet_lines: int = 10
    chunk_chars: int = 1_500
    min_chunk_chars: int = 100
    top_skills: int = 10
    top_quality: int = 3
    min_months: int = 1
    min_scores: dict[str, float] = field(default_factory=lambda: {"c2s": 0.15, "i2s": 0.15, "life_of_py": 0.15})
    big_commit_lines: int = 100
    drop_below_mean: float = 0.2
    relevant_above_mean: float = 0.4
    report_skills: int = 20
    report_commits: int = 10
    report_dirs: int = 3
    report_dir_lines: int = 50
    path_chars: int = 30
    batch_rows: int = 20
    #: Of a run's settings: the version its records carry, where the list of skills is, and the models by kind.
    version: str = "1"
    skill_list: str | None = None
    models: dict[str, list[str]] = field(default_factory=dict)


def from_ini(path: str) -> Config:
    """Reads what an INI file sets: limits from whichever section has them, others keep their defaults; and every section's models.

    A section's ``path`` is a model's main variant; ``alpha.path`` and ``beta.path`` are further ones.
    """
    ini = configparser.ConfigParser()
    ini.read(path)
    flat = {k: v for s in ini.sections() for k, v in ini.items(s)}
    scores = {**Config().min_scores}
    if "skill_min_score" in flat:
        scores |= {"c2s": float(flat["skill_min_score"]), "i2s": float(flat["skill_min_score"])}
    if "lop_min_score" in flat:
        scores["life_of_py"] = float(flat["lop_min_score"])
    models = {s: [ini[s][k] for k in ("path", "alpha.path", "beta.path") if k in ini[s]] for s in ini.sections() if "path" in ini[s]}
    return Config(min_months=int(flat.get("min_months", 1)), min_scores=scores, version=flat.get("version", "1"), skill_list=flat.get("skill_list"), models=models)
