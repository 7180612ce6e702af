"""Every threshold, weight and cap in one place; operators take a Settings argument."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # what the person is looking for
    target_titles: list[str] = field(default_factory=list)
    job_titles: list[str] = field(default_factory=list)
    preferred_locations: list[str] = field(default_factory=list)
    search_locations: list[str] = field(default_factory=list)
    target_countries: list[str] = field(default_factory=list)
    include_keywords: list[str] = field(default_factory=list)
    exclude_keywords: list[str] = field(default_factory=list)
    criteria_industries: list[str] = field(default_factory=list)
    search_industries: list[str] = field(default_factory=list)
    blacklist_companies: list[str] = field(default_factory=list)
    visa_constraints: list[str] = field(default_factory=list)
    remote_preference: str = "hybrid"
    experience_level: str = "mid"
    # query generation
    query_limit: int = 40
    german_variants: bool = False
    near_duplicate_threshold: float = 0.82
    query_order: str = "by_title"  # or "round_robin": the first of every list, then the second of every list, and so on
    max_titles: int = 15
    max_domains: int = 8
    max_skills: int = 6
    max_places: int = 6
    wide_titles: int = 10  # for title + domain + location, and for German variants
    wide_domains: int = 6
    wide_places: int = 4
    # query match
    match_score: float = 0.32
    match_title_overlap: float = 0.20
    match_overlap: float = 0.45
    # ranking
    label_top_n: int = 20
    label_min_rules_score: float = 55.0
    label_enabled: bool = True
    # evidence matching
    max_requirements: int = 15
    evidence_top_k: int = 3
    strong_threshold: float = 0.72
    partial_threshold: float = 0.50
    uncertain_threshold: float = 0.30
    # reports
    top_n: int = 20
