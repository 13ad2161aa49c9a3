"""logquarry.streaming"""
