"""deponent.plans"""
