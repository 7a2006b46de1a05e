"""Operators over DataFrames: arrays, statistics, signals, quadrature, interpolation, sparse algebra, optimisation."""
