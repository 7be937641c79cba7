"""The catalogue of queries."""


def catalogue() -> dict[str, tuple]:
    """name -> (query, SQL or None), over all modules of queries."""
    from turnstone.plans import activities, logs, streams, texts, vectors, watcher

    return vectors.QUERIES | texts.QUERIES | activities.QUERIES | streams.QUERIES | logs.QUERIES | watcher.QUERIES
