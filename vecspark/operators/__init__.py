"""vecspark.operators"""
