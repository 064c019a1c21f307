"""Phrases of texts on Spark: clauses, cuts, chunks, pages and their refreshes."""

__all__ = ["Options", "chunk_text", "chunks_by_clause", "cut_offsets", "mark", "register", "replies", "request_source", "segment", "visual_chunks"]


def __getattr__(name: str):
    if name not in __all__:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from . import api
    from .operators import chunker

    return getattr(api if hasattr(api, name) else chunker, name)
