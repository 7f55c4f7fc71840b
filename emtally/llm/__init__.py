"""Operations of a large training-data pipeline, as Spark jobs. Nothing else in the package imports this."""
