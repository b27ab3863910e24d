"""marlspark: retrieval, evaluation, record and conversation operators as Spark DataFrame functions."""
