"""vecspark.plans"""
