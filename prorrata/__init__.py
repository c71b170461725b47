"""Condominium expense accounting as Spark jobs: DataFrames in, DataFrames out."""
