"""logquarry.functions"""
