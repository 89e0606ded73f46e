"""The registered queries: what each computes with the library, and the same in ANSI SQL for an independent check."""

from . import cross_section, evaluation, factors, graphs, intraday, labels, portfolios, tables


def registered():
    """name -> Query, over all modules."""
    out = {}
    for module in (tables, factors, intraday, cross_section, labels, portfolios, evaluation, graphs):
        for name, query in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query name occurs twice: {name}")
            out[name] = query
    return out
