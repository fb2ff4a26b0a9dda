"""DataFrame operators: filters, index build, joins, ranking, features, geo, evaluation."""
