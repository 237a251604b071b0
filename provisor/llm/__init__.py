"""Operators that prepare text corpora for model training."""


def load_queries() -> tuple[dict, dict]:
    """Registered queries and their SQL."""
    from provisor.llm import queries, registry

    return dict(registry.QUERIES), dict(registry.ORACLES)
