"""logquarry.plans"""
