"""Support-call analysis as Spark jobs: instructions, clicks, their binding, articles and evaluation."""
