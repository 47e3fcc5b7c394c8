"""Feature tables, MLlib models, evaluation and batch scoring."""
