"""descry: building and judging property-prediction models as Spark jobs."""
