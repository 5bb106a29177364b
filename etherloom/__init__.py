"""Spark-native analytics of broadcast information elements: how identifying is each field?"""
