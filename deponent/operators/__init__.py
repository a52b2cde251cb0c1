"""deponent.operators"""
