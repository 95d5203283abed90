"""Spark-native analytics for program-analysis data: traces, dialogues, state, graphs, labelled code."""
