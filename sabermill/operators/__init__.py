"""Relational, windowed, statistical and search operators over DataFrames with named columns."""
