"""skeinlake: a knowledge-graph and corpus analytics engine expressed in PySpark."""
