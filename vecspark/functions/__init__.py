"""vecspark.functions"""
