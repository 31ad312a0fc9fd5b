"""Compositions of operators: preprocessing, evaluation, the stage chain and the query catalogue."""
