"""quire: document analytics and purchase decisions as Spark DataFrame operators."""
