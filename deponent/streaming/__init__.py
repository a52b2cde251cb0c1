"""deponent.streaming"""
