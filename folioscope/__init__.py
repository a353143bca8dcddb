"""folioscope: document indexing and hybrid retrieval analytics as Spark jobs."""
