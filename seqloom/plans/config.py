"""Settings of a run, read from JSON and checked at once."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Library:
    left: str
    right: str
    bam: str
    insert_mean: int
    insert_sd: int


@dataclass(frozen=True)
class Config:
    draft: str
    libraries: list[Library]
    kmers: list[tuple[int, list[int]]]
    threads: int = 10
    min_gap: int = 100
    flank: int = 300
    output: str = ""
    verbose: bool = False
    software: dict[str, str] = field(default_factory=dict)


def _need(d: dict, *path: str):
    for p in path:
        if not isinstance(d, dict) or p not in d:
            raise ValueError(f"missing setting: {'.'.join(path)}")
        d = d[p]
    return d


def load(text: str) -> Config:
    """A :class:`Config` from JSON text; a missing key or differing numbers of read sets and alignments is an error.

    Numbers may be strings. A library whose two mates are one file gives a warning.
    """
    d = json.loads(text)
    reads, alns = _need(d, "raw_reads"), _need(d, "alignments")
    if len(reads) != len(alns):
        raise ValueError(f"{len(reads)} read sets but {len(alns)} alignments")
    libraries = []
    for r, a in zip(reads, alns, strict=True):
        if _need(r, "left") == _need(r, "right"):
            warnings.warn(f"both mates are read from {r['left']}", stacklevel=2)
        libraries.append(Library(r["left"], r["right"], _need(a, "bam"), int(_need(a, "is")), int(_need(a, "std"))))
    p = _need(d, "parameters")
    kmers = [(int(_need(k, "k")), [int(_need(v, "k") if isinstance(v, dict) else v) for v in _need(k, "k_velvet")]) for k in _need(d, "kmer_length")]
    get = lambda *names, default: next((p[n] for n in names if n in p), default)
    return Config(_need(d, "draft_genome", "fa"), libraries, kmers, int(get("nthreads", "threads", default=10)), int(get("min_gap_size", "min_gap", default=100)), int(get("flank_length", "flank", default=300)), str(get("working_folder", "output", default="")), str(get("verbose", default="0")).lower() in ("1", "true"), dict(d.get("software_path", {})))
