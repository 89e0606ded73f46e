"""DataFrame-to-DataFrame operators: joins, cross-sections, intraday, labels, portfolios, evaluation."""
