"""deponent.functions"""
