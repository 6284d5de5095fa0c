"""Spark-native authorship analytics: who, people or coding agents, wrote a code base."""
