"""Learning-content and learner-progress jobs as Spark DataFrame operators."""
