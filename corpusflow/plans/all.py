"""Import every query module so that the registry is complete."""

from __future__ import annotations


def load():
    from corpusflow.plans import (q_corpus, q_features, q_files, q_gradient, q_model, q_split, q_stream,  # noqa: F401
                                  q_subwords, q_telemetry, q_train)
    from corpusflow.plans.registry import REGISTRY
    return REGISTRY
