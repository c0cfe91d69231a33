"""Settings of indexing and ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

# Weights of the tags in which a word stands.
TAG_WEIGHTS = {
    "b": 0.2,
    "strong": 0.2,
    "h1": 1.0,
    "h2": 0.8,
    "h3": 0.5,
    "h4": 0.3,
    "h5": 0.2,
    "h6": 0.2,
    "title": 3.0,
    "meta": 3.0,
}


@dataclass(frozen=True)
class Config:
    """Weights of the score, bounds of results and index settings."""

    tfidf_weight: float = 50.0
    tag_weight: float = 10.0
    depth_weight: float = 5.0
    run_weight: float = 10.0
    tag_weights: dict[str, float] = field(default_factory=lambda: dict(TAG_WEIGHTS))
    most_tags: int = 100
    most_results: int = 250
    most_postings: int = -1
    page_size: int = 15
    #: Three and more terms never earn the run weight where true.
    compat_labels: bool = False
    #: Words of a vocabulary up to which its stems are sent to every task.
    broadcast_words: int = 500_000
    #: Terms of queries up to which they are sent to every task, and up to which they are literals of a scan.
    broadcast_terms: int = 100_000
    literal_terms: int = 1_000

    @staticmethod
    def from_json(path: str) -> Config:
        import json

        with open(path, encoding="utf-8") as f:
            return Config(**json.load(f))
