"""vecspark.streaming"""
