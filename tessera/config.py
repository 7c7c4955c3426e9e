"""Settings of retrieval, chunking and evaluation, with the usual environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: int):
    return field(default_factory=lambda: int(os.environ.get(name, default)))


def _name(name: str, default: str):
    return field(default_factory=lambda: os.environ.get(name, default))


@dataclass(frozen=True)
class Config:
    # Names of the models that a deployment wraps; nothing here loads one.
    embedding_model: str = _name("EMBEDDING_MODEL", "sentence-transformers/all-MiniLM-L6-v2")
    embedding_model_urdu: str = _name("EMBEDDING_MODEL_URDU", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2")
    generator_model: str = _name("HF_MODEL_ID", "mistralai/Mistral-7B-Instruct-v0.2")
    judge_model: str = "llama-3.3-70b-versatile"
    top_k: int = _env("TOP_K_RETRIEVE", 20)
    top_k_final: int = _env("TOP_K_RERANK", 5)
    rrf_k: int = 60
    chunk_size: int = 700
    overlap: int = 120
    inner_overlap: int = 80
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    max_claims: int = _env("EVAL_MAX_CLAIMS", 5)
