"""Operations of a large training-data pipeline on Spark tables."""
