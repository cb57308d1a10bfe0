"""vecspark.sources"""
